import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from framesieve.llm import kneser_ney as kn

TEXTS = ["the cat sat on the mat", "the dog sat on a log", "a cat and a dog", "on and on the dog ran", "that hat is a mat", "no one sat there then"] * 3 + ["rare wörds qui zap"]


def grams(text, order):
    symbols = kn.BEGIN * (order - 1) + b" ".join(text.encode().split()) + kn.END
    return [tuple(symbols[i : i + order]) for i in range(len(symbols) - order + 1)]


def brute(texts, order):
    """Function from (context, word) to its interpolated probability, straight from the definition."""
    counts = [Counter(g for t in texts if t.split() for g in grams(t, order))]
    for _ in range(order - 1):
        counts.append(Counter(g[1:] for g in counts[-1]))
    counts.reverse()
    tables = []
    for c in counts:
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) if all(n) else k / 2 for k in (1, 2, 3)]
        follow = defaultdict(dict)
        for g, v in c.items():
            follow[g[:-1]][g[-1]] = v
        tables.append((d, follow, {h: (sum(f.values()), sum(d[min(v, 3) - 1] for v in f.values())) for h, f in follow.items()}))

    def p(context, word, k):
        if k == 0:
            return 1 / (len(tables[0][1][()]) + 1)
        d, follow, sums = tables[k - 1]
        h = context[len(context) - (k - 1) :]
        lower = p(context, word, k - 1)
        if h not in follow:
            return lower
        own, (total, spared) = follow[h].get(word, 0), sums[h]
        return (own - d[min(own, 3) - 1] if own else 0) / total + spared / total * lower

    return lambda context, word: p(context, word, order)


def perplexity(p, text, order):
    found = grams(text, order)
    return math.exp(-math.fsum(math.log(p(g[:-1], g[-1])) for g in found) / len(found))


def test_probabilities_sum_to_one():
    p = brute(TEXTS, 3)
    symbols = {c for t in TEXTS for c in t.encode()} | {kn.END[0]}
    for context in ((kn.BEGIN[0], kn.BEGIN[0]), tuple(b"th"), tuple(b"zz")):
        assert math.isclose(sum(p(context, c) for c in symbols) + p(context, ord("~")), 1.0)


@pytest.mark.parametrize("order", [1, 3, 6])
@pytest.mark.parametrize("chunk", [10, 10**6])
def test_scores_are_the_definition(spark, monkeypatch, order, chunk):
    monkeypatch.setattr(kn, "LISTED", 5)
    monkeypatch.setattr(kn, "CHUNK", chunk)
    table = spark.createDataFrame([(k, "en", t) for k, t in enumerate(TEXTS)], "key long, lang string, text string").coalesce(1)
    model = kn.build_model(kn.count_ngrams(table, order), order)
    probes = [*TEXTS[:6], "the the cat", "zzz", "mat mat mat zzz on", "  \n", "", "wörds " * 40, "x" * 1_000_000, "é" * 40_000, "\x02 \x03 cat"]
    rows = spark.createDataFrame([(k, "en", t) for k, t in enumerate(probes)] + [(99, "fr", "bonjour"), (98, "en", None)], table.schema).coalesce(2)
    got = {r["key"]: r for r in kn.scores(rows, model, order).collect()}
    p = brute(TEXTS, order)
    assert len(got) == len(probes) + 2
    assert got[99]["loglik"] is None and got[98]["symbols"] == 0
    for k, text in enumerate(probes):
        assert got[k]["symbols"] == (len(grams(text, 1)) if text.split() else 0)
        if text.split():
            assert math.isclose(math.exp(-got[k]["loglik"] / got[k]["symbols"]), perplexity(p, text, order), rel_tol=1e-9)


def test_rows(spark):
    rows = [(k, t, "en" if k % 2 else None) for k, t in enumerate(TEXTS * 4)] + [(900, "XQ!! ZV!! ### " * 9, "en"), (901, None, "en"), (902, " \n", None), (903, "bonjour", "fr"), (904, "the cat sat on the mat " * 20_000, "en"), (None, "the cat sat on the mat", "en"), (1, TEXTS[1], "en")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, kept boolean")
    trusted = spark.createDataFrame([(k, "x") for k in [*range(60), 5, None]], "doc_id long, text string")
    found = kn.quality(docs, trusted).collect()
    assert sorted(map(str, [r["doc_id"] for r in found])) == sorted(str(r[0]) for r in rows)
    by = {r["doc_id"]: r for r in found}
    assert not by[900]["kept"] and not by[901]["kept"] and not by[902]["kept"] and by[None]["kept"]
    assert by[903]["perplexity"] is None and by[903]["kept"] and by[904]["perplexity"] > 1
    assert kn.quality(docs.limit(0), trusted).count() == 0
    assert all(r["kept"] == (r["doc_id"] not in (901, 902)) for r in kn.quality(docs, trusted.limit(0)).collect())


def test_shuffled_words_are_less_likely(spark):
    table = spark.createDataFrame([(k, "en", t) for k, t in enumerate(TEXTS)], "key long, lang string, text string")
    model = kn.build_model(kn.count_ngrams(table))
    probes = spark.createDataFrame([(0, "en", TEXTS[0]), (1, "en", "mat the on sat cat the")], table.schema)
    got = {r["key"]: r["loglik"] for r in kn.scores(probes, model).collect()}
    assert got[0] > got[1] + 1


def test_whole_query_is_brute_force(spark):
    from framesieve.llm.queries import op6_quality

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trusted = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    held = {r["doc_id"] for r in docs.filter(kn.held_out(F.col("doc_id"))).select("doc_id").collect()}
    rows = [(r["doc_id"], r["lang"] or "", r["text"] or "") for r in docs.collect()]
    got = {r["doc_id"]: r for r in op6_quality(spark, sf).collect()}
    assert len(got) == len(rows)
    for lang in {r[1] for r in rows}:
        model = brute([t for k, own, t in rows if own == lang and k in trusted - held], kn.ORDER)
        want = {k: perplexity(model, t, kn.ORDER) if t.split() else None for k, own, t in rows if own == lang}
        judges = sorted(v for k, v in want.items() if k in trusted & held and v) or sorted(v for k, v in want.items() if k in trusted and v)
        level = judges[math.ceil(kn.QUANTILE * len(judges)) - 1]
        edge = math.exp((math.floor(math.log(level) / kn.BIN) + 1) * kn.BIN)
        for k, value in want.items():
            assert (got[k]["perplexity"] is None) == (value is None)
            if value is not None:
                assert math.isclose(got[k]["perplexity"], value, rel_tol=1e-9)
                assert math.isclose(got[k]["threshold"], edge, rel_tol=1e-9)
                assert got[k]["kept"] == (value <= edge)
            else:
                assert not got[k]["kept"]


def test_threshold_is_the_quantile(spark):
    values = [1 + k / 100 for k in range(1000)]
    table = spark.createDataFrame([("en", v) for v in values], "lang string, perplexity double")
    (row,) = kn.thresholds(table, 0.9).collect()
    assert sum(v <= row["threshold"] for v in values) >= 900 and abs(math.log(row["threshold"] / values[899])) <= 2 * kn.BIN
