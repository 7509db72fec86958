"""Sessions, bursts, linkage and the knockout against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from framesieve.operators import archive, components, knockout, linkage, pairs, runs
from framesieve.plans import pair_queries, views


def plain_linkage(ids, close, forced):
    """Merges the closest whole pair again and again, looking at all pairs each time."""
    clusters = [{i} for i in ids]
    for group in forced:
        hit = [c for c in clusters if c & set(group)]
        clusters = [c for c in clusters if c not in hit] + ([set().union(*hit)] if hit else [])
    while True:
        best = None
        for a, b in itertools.combinations(sorted(clusters, key=min), 2):
            d = [close.get((min(i, j), max(i, j))) for i in a for j in b]
            if None not in d and (best is None or (max(d), min(a), min(b)) < best[0]):
                best = ((max(d), min(a), min(b)), a, b)
        if best is None:
            return sorted(sorted(c) for c in clusters)
        clusters = [c for c in clusters if c not in best[1:]] + [best[1] | best[2]]


@pytest.mark.parametrize("seed", range(60))
def test_linkage_equals_the_plain_one(seed):
    rng = random.Random(seed)
    ids = list(range(rng.randint(1, 14)))
    close = {p: rng.choice([0.1, 0.2, 0.3, 0.4]) for p in itertools.combinations(ids, 2) if rng.random() < 0.6}
    forced = [rng.sample(ids, min(len(ids), 3))] if rng.random() < 0.5 else []
    assert linkage.complete_linkage(ids, close, forced) == plain_linkage(ids, close, forced)


def test_components_apart_equal_the_whole(spark):
    rng = random.Random(3)
    ids = list(range(80))
    close = {p: rng.choice([0.1, 0.2, 0.3]) for p in itertools.combinations(ids, 2) if rng.random() < 0.03}
    forced = [[1, 2, 3], [10, 70]]
    rows = spark.createDataFrame([(i, float(i)) for i in ids], "id long, t double")
    table = spark.createDataFrame([(j, i, d) for (i, j), d in close.items()] + [(0, 79, 0.9)], "i long, j long, dist double")
    tied = spark.createDataFrame([(i, f"r{k}") for k, g in enumerate(forced) for i in g], "id long, run string")
    found = {}
    for g, k, i in linkage.groups(rows, table, tied, 0.5, 100).collect():
        found.setdefault(g, []).append((k, i))
    assert sorted([i for _, i in sorted(v)] for v in found.values()) == plain_linkage(ids, close, forced)


def test_split():
    time = {k: 0.0 for k in range(4)} | {4: 10.0, 5: 10.5, 6: 30.0}
    assert linkage.split_at_gaps([*time], time, 3) == [[0], [1, 2, 3], [4, 5], [6]]
    assert linkage.split_at_gaps([2, 1], {1: 5.0, 2: 1.0}, 2) == [[2, 1]]


def test_connected(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 60), (7, 7)]
    found = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "i long, j long")).collect()}
    assert found == {i: 0 for i in range(41)} | {50: 50, 60: 50, 100: 50}
    assert components.connected(spark.createDataFrame([], "i long, j long")).count() == 0


def test_sessions_over_slices(spark):
    rng = random.Random(1)
    times = sorted(rng.choice([None, rng.uniform(0, 400_000)]) or 0.0 for _ in range(300))
    rows = [(k, t if t else None) for k, t in enumerate(times)]
    want, n, before = {}, 0, None
    for k, t in sorted(rows, key=lambda r: (r[1] or 0.0, r[0])):
        n += before is not None and before[1] is not None and t is not None and t - before[1] > 1800
        want[k], before = n, (k, t)
    got = {r["id"]: r["segment_id"] for r in runs.sessions(spark.createDataFrame(rows, "id long, ts double"), slice_seconds=5000.0).collect()}
    assert got == want


def test_near_identical_captures(spark):
    """Two shots a second apart and one an hour later; then the same hash across a long gap; then evidence."""
    def groups(rows, evidence=None):
        columns = "id long, ts double, phash string, dhash string, whash string, ahash string, prefix string, number long, camera string, lens string, focal double, aperture double, lat double, lon double, rejected boolean, score double, color_hist array<double>, path string"
        table = spark.createDataFrame([(k, t, h, h, h, h, p, n, None, None, None, None, None, None, False, 50.0, c, f"{p}{n}") for k, (p, n, h, t, c) in enumerate(rows)], columns)
        table = runs.sessions(table)
        found = pairs.fast_pairs(table, ["segment_id"], spark.createDataFrame(evidence, "i long, j long, inliers long") if evidence else None, color="color_hist")
        burst = runs.burst_runs(table, time="ts")
        tied = runs.forced_groups(table, burst).selectExpr("id", "concat(prefix, run_id) as run")
        out = {}
        for g, k, i in linkage.groups(table.withColumnRenamed("ts", "t"), found, tied, 0.38, 25).collect():
            out.setdefault(g, []).append((k, i))
        return sorted([i for _, i in sorted(v)] for v in out.values())

    one = [1.0, 0.0, 0.0]
    assert groups([("IMG_", 1, "f" * 16, 100.0, one), ("IMG_", 2, "f" * 15 + "e", 101.0, one), ("IMG_", 100, "0" * 16, 4000.0, one)]) == [[0, 1], [2]]
    assert groups([("IMG_", 1, "f" * 16, 100.0, one), ("IMG_", 2, "f" * 16, 4000.0, one)]) == [[0], [1]]
    apart = [("A_", 1, "f" * 16, 100.0, [0.7, 0.3, 0.0]), ("B_", 1, "f" * 12 + "0000", 105.0, [0.7, 0.3, 0.0])]
    assert groups(apart) == [[0], [1]] and groups(apart, [(0, 1, 30)]) == [[0, 1]]


def played(images, *decisions):
    k = knockout.Knockout(images)
    for d in decisions:
        k.apply(*(d if isinstance(d, tuple) else ("choose", d)))
    return k


def test_knockout():
    assert played("a").winner == "a" and played("").finished
    k = played("ab", "right")
    assert (k.winner, k.losers, k.finished) == ("a", ["b"], True)
    assert played("ab", "left").winner == "b"
    k = played("ab", "both")
    assert (k.winner, k.losers, k.finished) == (None, ["a", "b"], True)
    k = played("ab", "neither")
    assert (k.winner, k.extra_winners, k.finished) == (None, ["a", "b"], True)
    assert played("abc", "right", "left").winner == "c"
    k = played("abc", ("kick", "left"))
    assert (k.left, k.right, k.losers) == ("c", "b", ["a"])
    k = played("abc", "both")
    assert (k.left, k.right, k.finished) == ("c", None, False)
    assert played("abc", ("reset", "")).finished and played("abc", ("reset", "b")).winner == "b"
    k = played("abc", "right", "left", ("undo", None))
    assert (k.left, k.right, k.losers, k.finished) == ("a", "c", ["b"], False)
    k = played("abc", "right", "left", ("reopen", None))
    assert (k.left, k.right, k.pending, k.losers) == ("a", "b", ["c"], [])
    assert played("ab", "other").left == "a" and played("abc", ("skip", None)).skips == 1


def test_archive(spark, tmp_path):
    images = spark.createDataFrame([(1, 0, "x/a.jpg"), (1, 1, "y/a.jpg"), (1, 2, "x/b.jpg"), (2, 0, "x/c.jpg"), (2, 1, "x/d.jpg")], "group_id long, pos int, path string")
    made = spark.createDataFrame([(1, 0, "choose", "neither"), (1, 1, "choose", "left")], "group_id long, seq long, action string, arg string")
    states = knockout.replay(images, made)
    side = spark.createDataFrame([("x/a.jpg", "x/a.XMP"), ("y/a.jpg", "y/a.CR2")], "primary string, companion string")
    taken = spark.createDataFrame([("winners/a.jpg",), ("winners/a_2.jpg",)], "path string")
    plan = archive.transfer_plan(states, side, taken)
    rows = [(r["src"], r["dst"], r["kind"]) for r in plan.orderBy("group_id", "seq").collect()]
    assert rows == [("x/a.jpg", "winners/a_1.jpg", "winner"), ("x/a.XMP", "winners/a_1.XMP", "winner_companion"), ("y/a.jpg", "winners/a_3.jpg", "winner"), ("y/a.CR2", "winners/a_3.CR2", "winner_companion"), ("x/b.jpg", "losers/b.jpg", "loser")]
    for src, _, _ in rows[:-1]:
        (tmp_path / src).parent.mkdir(exist_ok=True)
        (tmp_path / src).write_text(src)
    failed = archive.execute(plan, str(tmp_path), move=True)
    assert [f[0] for f in failed] == ["x/b.jpg"] and (tmp_path / "winners/a_3.CR2").read_text() == "y/a.CR2" and not (tmp_path / "x/a.jpg").exists()
    here = spark.createDataFrame([(r[1],) for r in rows[:-1]], "path string")
    undo = archive.revert_plan(plan, here, moved=True).orderBy("seq").collect()
    assert [(r["src"], r["failure"]) for r in undo][0] == ("losers/b.jpg", "target missing") and undo[1]["dst"] == "y/a.CR2"
    after = archive.committed(images.select("path"), plan).collect()
    assert sorted(r["path"] for r in after) == ["losers/b.jpg", "winners/a_1.jpg", "winners/a_3.jpg", "x/c.jpg", "x/d.jpg"]


def test_near_pairs_cross_slots(spark):
    rows = [(i, "s", t) for i, t in enumerate([0.0, 599.0, 601.0, 1201.0, 2399.0, 2401.0, 4199.5, 4202.0, None, -1.0])] + [(20, "r", 600.0), (21, "r", None)]
    table = spark.createDataFrame(rows, "id long, k string, ts double")
    want = [(a, b) for a, k, s in rows for b, m, t in rows if a < b and k == m and (s is None or t is None or abs(s - t) <= 600)]
    got = pairs.near_pairs(table, ["k"], 600.0).select("a.id", F.col("b.id").alias("j")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_registered_linkage_takes_whole_sessions(spark):
    sf = "/root/testdata/sf0.001"
    rows = runs.sessions(views.captures(spark, sf))
    whole = pairs.fast_pairs(rows, ["segment_id"]).filter("dist <= 0.46")
    tied = runs.forced_groups(rows, runs.burst_runs(views.bursts(spark, sf))).select("id", F.concat_ws(":", "segment_id", "prefix", "run_id").alias("run"))
    want = linkage.groups(rows.withColumn("t", F.col("ts")), whole, tied, 0.46, 20).collect()
    assert sorted(map(tuple, pair_queries.complete_linkage_forced(spark, sf).collect())) == sorted(map(tuple, want))


def test_bounded_expert_pairs_lose_none(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CELL", 16)
    monkeypatch.setattr(pairs, "STRIPE", 64)
    rng = random.Random(5)
    rows = []
    for k in range(90):
        vector = [None, [], [0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0], [1.0, 0.0], [1.0, None, 0.0]][k % 11] if k % 11 < 6 else [rng.uniform(-0.3, 1.0) for _ in range(3)]
        faces, lat = rng.choice([None, 0, 1]), rng.choice([None, 31.0])
        rows.append((k, rng.choice(["s", "t", None]), rng.choice([None, rng.uniform(0, 300)]), vector, "c", None, rng.choice(["A", "B"]), rng.choice([None, rng.randrange(60)]), lat, lat, faces))
    table = spark.createDataFrame(rows, "id long, k string, mtime double, embedding array<double>, camera string, lens string, prefix string, number long, lat double, lon double, faces int")
    for face in (None, F.lit(0.9)):
        want = pairs.expert_pairs(table, ["k"], face).filter("dist <= 0.46").collect()
        bounded = pairs.expert_pairs(table, ["k"], face, cutoff=0.46)
        got = bounded.collect()
        assert len(want) > 50 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    candidates = pairs._expert_candidates(table, ["k"], 0.46, False).count()
    assert candidates < pairs.blocked_pairs(table, ["k"]).count()
