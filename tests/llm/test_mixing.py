import hashlib
import random
import re

import pytest

from framesieve.llm import mixing


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), repeats=3):
    """Shares the total by weight, again and again, until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(repeats * sizes[s])
            free.discard(s)
        left = sum(sizes.values()) - sum(target.values())


def h(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16)


def brute(rows):
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (_, t, _) in enumerate(rows)}
    of = {}
    for k, (_, _, s) in enumerate(rows):
        of[s] = of.get(s, 0) + size[k]
    target, out = brute_targets(of), []
    for s, total in of.items():
        full = min(int(target[s] // total), 3) if total else 0
        rest, chosen = target[s] - full * total, set()
        if total and full < 3:
            run = 0
            for x in sorted({h(r[0]) for r in rows if r[2] == s}):
                n = sum(size[k] for k, r in enumerate(rows) if r[2] == s and h(r[0]) == x)
                if run + n <= rest:
                    run += n
                    chosen.add(x)
                    continue
                if run + n - rest < rest - run:
                    chosen.add(x)
                break
        out += [(r[0], size[k], total, pytest.approx(target[s]), size[k] * (full + (h(r[0]) in chosen))) for k, r in enumerate(rows) if r[2] == s]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    sources = ["hot"] * 12 + ["b", "c", "d", None, "é", "empty"]
    rows = []
    for k in range(500):
        s = rng.choice(sources)
        rows.append((k, None if rng.random() < 0.02 else "" if s == "empty" else " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 5, 40, 400 if k % 50 == 0 else 8]))), s))
    rows += [rows[3], (None, "a\x0bb\x1cc", "b"), (None, "x y", "b")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    got = mixing.mix_sources(docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    key = lambda r: (str(r[0]), r[1], r[2], r[4])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in taken.collect()) == sum(r["taken"] for r in got.collect())


def test_limits(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "x")], "doc_id long, text string, source string")
    assert {tuple(r) for r in mixing.mix_sources(docs).collect()} == {(1, 2, 3, 3.0, 2), (2, 1, 3, 3.0, 1)}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert {tuple(r) for r in mixing.mix_sources(docs.selectExpr("doc_id", "cast(null as string) text", "source")).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
