from framesieve.operators.knockout import Knockout
from framesieve.streaming import feeds


def test_live_knockout_equals_the_fold(spark, tmp_path):
    schema = "group_id long, seq long, action string, arg string"
    first = [(1, k, "image", c) for k, c in enumerate("abc")] + [(2, 0, "image", "x"), (1, 3, "choose", "right")]
    second = [(1, 4, "choose", "left"), (2, 1, "skip", None), (1, 5, "undo", None), (1, 6, "choose", "both")]
    source = tmp_path / "in"
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(source))
    query = feeds.live_knockout(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(str(source))
        query.processAllAvailable()
    finally:
        query.stop()
    fold = Knockout("abc")
    for action, arg in (("choose", "right"), ("choose", "left"), ("undo", None), ("choose", "both")):
        fold.apply(action, arg)
    rows = [tuple(r) for r in spark.table("live").filter("group_id = 1").collect()]
    assert tuple(fold.row(1)) in [tuple(r) for r in rows]
    assert spark.table("live").filter("group_id = 2 AND winner = 'x' AND skips = 1").count() == 1


def test_windows_and_arrivals(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.jpg").write_bytes(b"1")
    query = feeds.arriving_files(spark, str(folder)).writeStream.format("memory").queryName("files").outputMode("append").option("checkpointLocation", str(tmp_path / "cp1")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [r["size"] for r in spark.table("files").collect()] == [1]
    rows = spark.createDataFrame([(1_000, "a"), (1_100, "a"), (9_000, "a"), (1_050, "b")], "s long, kind string").selectExpr("timestamp_seconds(s) as ts", "kind")
    assert {(r["kind"], r["n"]) for r in feeds.session_counts(rows, by=["kind"]).collect()} == {("a", 2), ("a", 1), ("b", 1)}
    assert sum(r["n"] for r in feeds.windowed_counts(rows, "ts", "10 minutes", "5 minutes", "kind").collect()) == 8
