import math
import random

from pyspark.sql import functions as F

from framesieve.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score long, rank string"


def brute(rows, k=20, step=20):
    good = []
    for key, v in rows:
        if key is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v):
            good.append((key, [math.floor(64 * x) for x in v]))
    out = []
    for qk, q in {(a, tuple(b)) for a, b in good if a % step == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, v)), key) for key, v in good if key != qk)[:k]
        out += [(qk, i + 1, key, -s) for i, (s, key) in enumerate(found)]
    return sorted(out)


def test_all_kinds_of_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "SEEDS", 30)
    rng = random.Random(5)
    rows = [(i, [round(1024 * rng.gauss(0, 1) * (3 if j < 2 else 0.2)) / 1024 for j in range(8)]) for i in range(300)]
    rows += [(i, list(rows[7][1])) for i in range(300, 330)]  # ties
    rows += [(40, None), (60, [1.0, None]), (80, [float("nan")] * 8), (100, [float("inf")] * 8), (None, [1.0] * 8), (120, []), (140, [2.0, 1.0]), (400, [2.0**40] + [0.0] * 7), (20, rows[20][1])]
    table = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], SCHEMA)
    got = topk.top_k(table, F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == [(q, r, v, s) for q, r, v, s in brute(rows)]


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0], 0, ""), (20, [0.5], 0, ""), (3, [-1.0], 0, "")], SCHEMA)
    assert sorted(map(tuple, topk.top_k(few, F.col("vec_id") % 20 == 0).collect())) == [(0, 1, 20, 2048), (0, 2, 3, -4096), (20, 1, 0, 2048), (20, 2, 3, -2048)]
    assert topk.top_k(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_longer_vectors_after_shorter_ones(spark, monkeypatch):
    """Files come back largest first, many to a task; here the shortest vectors have the most components and so the largest files."""
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "SEEDS", 24)
    rng = random.Random(11)
    rows = []
    for i in range(1600):
        length, width = 40 * 0.995**i, 2 + i // 40
        v = [rng.gauss(0, 1) for _ in range(width)]
        by = length / math.sqrt(sum(x * x for x in v))
        rows.append((i, [round(1024 * by * x) / 1024 for x in v]))
    table = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], SCHEMA).repartition(8)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 20 == 0).collect()))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == brute(rows)
