"""Rules of the library against fixed results and plain Python."""

import itertools
import os
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from framesieve.functions import quality, text
from framesieve.operators import archive, faces, knockout, pairs, runs
from framesieve.plans import catalogue
from framesieve.sources import cache, images


def test_reason_of_a_rejection_by_score_alone(spark):
    rows = [(["subject_blurry", "flat_tone"], True), (["subject_blurry", "too_small"], True), ([], True), (["flat_tone"], False), (["tiny_file"], True)]
    got = spark.createDataFrame(rows, "f array<string>, r boolean").select(quality.reject_reason(F.col("f"), F.col("r")).alias("x")).collect()
    assert [r["x"] for r in got] == [quality.LOW_SCORE_REASON, quality.REASONS["subject_blurry"], quality.LOW_SCORE_REASON, None, quality.REASONS["tiny_file"]]


def test_applied_rules(spark):
    base = {"flags": F.array(F.lit("x")), "score": F.lit(5.0), "auto_reject": F.lit(False), "reject_reason": F.lit(None).cast("string")}
    made = [quality.with_aesthetic(base, F.lit(10.0), F.lit(0.1)), quality.with_faces(base, F.array(F.lit("all_eyes_closed"))), quality.with_reply(base, F.lit("REJECT"), F.lit("why")), quality.with_reply(base | {"auto_reject": F.lit(True)}, F.lit("pass"), F.lit("ok"))]
    names = ("flags", "score", "auto_reject", "reject_reason")
    got = [tuple(r) for m in made for r in spark.range(1).select(*[m[n].alias(n) for n in names]).collect()]
    assert got == [(["x", "low_aesthetic"], 0.0, True, quality.AESTHETIC_REASON), (["x", "all_eyes_closed"], 5.0, True, quality.FACE_REASON), (["x", "llm_reject"], 5.0, True, "why"), (["x", "llm_pass"], 5.0, False, None)]


def test_pairs_of_chunks_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CHUNK", 5)
    rows = spark.createDataFrame([(k, "a" if k < 23 else None if k > 40 else "b") for k in range(45)], "id long, g string")
    got = sorted((r["a"]["id"], r["b"]["id"]) for r in pairs.blocked_pairs(rows, ["g"]).collect())
    assert got == sorted(itertools.chain(itertools.combinations(range(23), 2), itertools.combinations(range(23, 41), 2)))


def test_candidates_stand_for_all_pairs(spark):
    hashes = ["0" * 16, "0" * 15 + "f", "f" * 16, None]
    rows = [(k, k * 40.0, f"P{k % 3}", k * 3, *[hashes[(k * 7 + j * (k % 2)) % 4] for j in range(4)]) for k in range(24)]
    table = spark.createDataFrame(rows, "id long, ts double, prefix string, number long, phash string, dhash string, whash string, ahash string")
    weights = (0.40, 0.30, 0.20, 0.10)

    def similar(a, b):
        both = [(w, 1 - (int(x, 16) ^ int(y, 16)).bit_count() / 64) for w, x, y in zip(weights, a, b, strict=True) if x and y]
        return sum(w * s for w, s in both) / sum(w for w, _ in both) if both else 0.0

    def wanted(a, b):
        return abs(a[1] - b[1]) <= 30 or (a[2] == b[2] and abs(a[3] - b[3]) <= 6) or similar(a[4:], b[4:]) >= 0.65

    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if wanted(a, b)}
    found = pairs.evidence_candidates(table).cache()
    assert {tuple(r) for r in pairs.all_candidates(found).collect()} == want
    blocks = table.select("id", F.floor(F.col("id") / 6).alias("block"))
    assert {tuple(r) for r in pairs.all_candidates(found, blocks).collect()} == {(i, j) for i, j in want if i // 6 == j // 6}


def test_bursts_do_not_depend_on_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "IMG_" if k % 3 else "P", k * (1 + k % 5 // 4), k * 0.7 if k % 7 else None, f"{k % 4:016x}") for k in range(200)], "id long, prefix string, number long, t double, phash string")
    want = sorted(map(tuple, runs.burst_runs(rows).collect()))
    monkeypatch.setattr(runs, "BURST_SLICE", 3)
    assert sorted(map(tuple, runs.burst_runs(rows).collect())) == want and len({r[-2:] for r in want}) > 5


def test_reuse_takes_the_nearest_good_record(spark):
    files = spark.createDataFrame([("a", 1, 100.0), ("b", 1, None), ("c", 2, 5.0), ("d", 3, 7.0)], "path string, size long, mtime double")
    old = spark.createDataFrame([("a", 1, 50.0, "x", 1), ("a", 1, 100.0, "y", 2), ("a", 1, 101.0, "z", None), ("b", 1, None, "n", 3), ("c", 2, 7.0, "late", 4), ("d", 9, 7.0, "size", 5)], "path string, size long, mtime double, record string, n long")
    reused, fresh = cache.split_reuse(files, old)
    assert sorted(tuple(r) for r in reused.select("path", "record", "n").collect()) == [("a", "y", 2), ("b", "n", 3)] and sorted(r["path"] for r in fresh.collect()) == ["c", "d"]


def test_archive_commit_and_revert(spark, tmp_path):
    states = spark.createDataFrame([(1, "a", ["b"], ["c", "d"]), (2, "e", [], [])], "group_id long, winner string, extra_winners array<string>, losers array<string>")
    moves = spark.createDataFrame([(1, 1, "a", "w/a", "winner"), (1, 2, "b", "w/b", "winner"), (1, 3, "c", "l/c", "loser")], "group_id long, seq long, src string, dst string, kind string")
    got = {r["group_id"]: tuple(r)[1:] for r in archive.committed_states(states, moves, move=True).collect()}
    assert got == {1: ("w/a", ["w/b"], ["l/c", "d"], True), 2: ("e", [], [], False)}
    assert archive.committed_states(states, moves, move=False).filter("group_id = 1").first()["winner"] == "a"
    for folder, name in (("w", "a"), ("w", "b"), ("", "b")):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / name).write_text(folder + name)
    plan = archive.revert_plan(moves, spark.createDataFrame([("w/a",), ("w/b",)], "path string"), moved=True)
    assert archive.revert(plan, str(tmp_path)) == [("l/c", "target missing")]
    assert (tmp_path / "a").read_text() == "wa" and (tmp_path / "b").read_text() == "b" and (tmp_path / "b_1").read_text() == "wb" and not list((tmp_path / "w").iterdir())


def test_restore_and_explanations(spark):
    k = knockout.Knockout(["a", "b", "c"])
    for action, arg in (("reject", "a"), ("reject", "c")):
        k.apply(action, arg)
    assert (k.winner, k.finished, k.losers) == ("b", True, ["a", "c"])
    k.apply("restore", "a")
    assert (k.left, k.right, k.finished, k.losers, k.restored) == ("a", "b", False, ["c"], ["a"])
    assert faces.face_overlap_pairs(spark.createDataFrame([([[1.0, 0.0]], [[0.6, 0.8]])], "a array<array<double>>, b array<array<double>>"), "a", "b", accept=0.7).first()["overlap"] == 0.0
    title = spark.range(1).select(text.group_title(F.lit("7"), F.lit(None).cast("string"), F.lit(1)).alias("t"), text.group_progress(F.lit(3), F.lit(0)).alias("p")).first()
    assert tuple(title) == ("组 #7", 0.0)


def test_metadata_with_place(spark):
    fields = [(0x010F, 2, 4, b"Abc\0"), (0x0112, 3, 1, struct.pack("<HH", 6, 0))]
    place = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, 200) + struct.pack("<HHI4s", 3, 2, 2, b"E\0\0\0") + struct.pack("<HHII", 4, 5, 3, 224) + bytes(4)
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + b"".join(struct.pack("<HHI4s", *f) for f in fields) + struct.pack("<HHII", 0x8825, 4, 1, 100) + bytes(4)
    data = head.ljust(100, b"\0") + place
    data = data.ljust(200, b"\0") + struct.pack("<6I", 31, 1, 30, 1, 0, 1) + struct.pack("<6I", 121, 1, 0, 1, 36, 1)
    table = images.metadata(spark.createDataFrame([("p", data)], "path string, content binary"))
    row = table.select(*[c.alias(n) for n, c in images.exif_columns(F.col("exif")).items()], F.col("exif")["orientation"].alias("turn")).first()
    assert (row["camera"], row["lat"], row["lon"], row["turn"], row["taken"]) == ("Abc", -31.5, 121.01, "6", None)


@pytest.fixture(scope="module")
def long_ids(tmp_path_factory):
    """Events whose numbers are over six digits, so that captures share paths."""
    folder = str(tmp_path_factory.mktemp("long"))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id + 1000000 AS event_id, * EXCLUDE (event_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["archive_commit", "revert_steps", "thumbnail_state", "rejects_by_group"])
def test_captures_that_share_a_path(spark, long_ids, name):
    folder, con = long_ids
    df = catalogue.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(columns).collect())


def test_pairs_are_dealt_to_a_fixed_number_of_tasks(spark):
    rows = spark.range(40).select("id", F.lit(1).alias("b"), F.col("id").cast("double").alias("ts"))
    for made, n in ((pairs.blocked_pairs(rows, ["b"]), 780), (pairs.near_pairs(rows, ["b"], 5.0), 185)):
        assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().toString()
        assert made.count() == n


def test_close_pairs_with_evidence_are_those_of_all_pairs(spark):
    from framesieve.plans import views

    rows = runs.sessions(views.captures(spark, "/root/testdata/sf0.001"))
    evidence = rows.select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), (F.col("user_id") % 100).alias("inliers"))
    want = pairs.fast_pairs(rows, ["segment_id"], evidence, seconds=1800.0).filter("dist <= 0.46").collect()
    got = pairs.fast_pairs(rows, ["segment_id"], evidence, seconds=1800.0, cutoff=0.46).collect()
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))
