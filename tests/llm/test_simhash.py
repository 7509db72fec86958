import itertools

import numpy as np
import xxhash
from pyspark.sql import functions as F

from framesieve.llm import common, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (key, fp); the smallest key that each row reaches."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(rows))]


def test_fingerprints():
    long = " ".join(f"w{i % 977} x{i}" for i in range(70_000))
    texts = [None, "", " \t", "One", "a b c d", "A b\x0bC\x1cd É é x x x x x x", long]
    got = simhash.fingerprints([None if t is None else t.encode() for t in texts])
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in texts]


def planted(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    near = base[rng.integers(0, n, 2 * n)].copy()
    for _ in range(5):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64) * rng.integers(0, 2, len(near), dtype=np.uint64)
    return np.unique(np.concatenate([base, near, np.arange(300, dtype=np.uint64)]))


def test_trie_links_all(spark, monkeypatch):
    keys = planted(400, 3)
    want = brute_components([(int(k), int(k)) for k in keys])
    table = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    for most, usual in ((1 << 20, 1 << 14), (310, 64)):
        monkeypatch.setattr(simhash, "MOST_IN_UNIT", most)
        monkeypatch.setattr(simhash, "USUAL_IN_NODE", usual)
        root = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(table)).collect()}
        classes = {}
        for k, w in zip(keys, want, strict=True):
            signed = int(np.int64(k.view(np.int64)))
            classes.setdefault(w, set()).add(root.get(signed, signed))
        assert all(len(c) == 1 for c in classes.values())
        assert len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_groups_of_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood tonight"
    rows = [(7, text, "a"), (3, text.upper(), "b"), (3, text, None), (None, text, "c"), (9, None, "d"), (8, "", "e"), (10, "  \n", "f"), (11, "x", "g"), (12, "y", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(simhash.simhash_groups(docs).select("doc_id", simhash.hex_fingerprint("fp").alias("f"), "component").collect(), key=str)
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    want = sorted(((k, f"{f:016x}", c) for (k, _, _), f, c in zip(rows, prints, brute_components([(r[0], f) for r, f in zip(rows, prints, strict=True)]), strict=True)), key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 8, 11, 12]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_kept_rows_are_the_same_in_any_order(spark, monkeypatch):
    text = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood tonight"
    rows = [(1, text, lang, source, "k", {"a": 1}) for lang in ("de", "en", None) for source in ("x", "y")] * 2 + [(2, text, "en", "z", "k", None), (5, None, None, None, None, None), (4, " ", "q", "q", "q", None)] + [(9, "other words here", "en", "x", "k", {"b": 2})] * 3
    schema = "`d.id` long, text string, __row__ string, __other__ string, __h__ string, m map<string,int>"
    docs = spark.createDataFrame(rows, schema)
    kept = [simhash.keep_first(d, key="d.id").collect() for d in (docs, spark.createDataFrame(rows[::-1], schema).repartition(7))]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1])) and sorted(r[0] for r in kept[0]) == [1, 4, 9] and kept[0][0].asDict().keys() == set(docs.columns)
    monkeypatch.setattr(simhash, "MARKED", (0, 0))
    monkeypatch.setattr("framesieve.llm.common.BROADCAST_ROWS", 0)
    assert sorted(map(str, simhash.keep_first(docs, key="d.id").collect())) == sorted(map(str, kept[0]))
    assert simhash.keep_first(docs.limit(0), key="d.id").count() == 0


def test_many_rows_to_drop_stay_off_the_driver(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"))
    kept = simhash.keep_first(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "LeftAnti" in line]
    assert joins and not any("Broadcast" in line for line in joins)
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_repeated_rows_of_a_dealt_join_stay_off_the_driver(spark):
    left = spark.range(60_000).select(F.col("id").alias("x"), (F.col("id") % 50_500).alias("k"))
    right = common.stored(spark.range(50_500).select(F.col("id").alias("own"), F.hex("id").alias("v")), "wide")
    out = common.dealt_join(left, right, F.col("k") == F.col("own"), F.col("x"))
    assert not any("Broadcast" in line for line in out._jdf.queryExecution().executedPlan().toString().splitlines())
    assert out.count() == 60_000 and out.filter("v <> hex(k)").count() == 0


def test_query_matches_brute_force(spark):
    from framesieve.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    want = {(k, f"{f:016x}", c) for (k, f), c in zip(prints, brute_components(prints), strict=True)}
    assert {tuple(r) for r in QUERIES["op1_simhash"](spark, sf).collect()} == want
