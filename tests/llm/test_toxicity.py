import numpy as np

from framesieve.llm import toxicity


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    score = x @ np.array([2.0, -1.0, 0.0])
    y = np.searchsorted([-1.0, 0.5, 2.0], score + rng.logistic(size=4000))
    w, t = toxicity.fit_ordinal([dict(enumerate(r)) for r in x], y, 3, 4, ridge=0.01, rounds=600)
    assert np.allclose(w, [2, -1, 0], atol=0.2) and np.allclose(t, [-1, 0.5, 2], atol=0.2)


def test_gradient_is_the_likelihoods():
    rng = np.random.default_rng(2)
    rows, y = [{0: v} for v in rng.normal(size=300)], rng.integers(0, 3, 300)
    w, t = toxicity.fit_ordinal(rows, y, 1, 3, ridge=0.0, rounds=2000)

    def loss(w, t):
        s = np.array([r[0] for r in rows]) * w
        f = lambda z: 1 / (1 + np.exp(-z))
        upper, lower = np.where(y < 2, f(t[np.minimum(y, 1)] - s), 1), np.where(y > 0, f(t[np.maximum(y - 1, 0)] - s), 0)
        return -np.log(upper - lower).sum()

    least = loss(w[0], t)
    assert all(loss(w[0] + d, t + np.array(e)) >= least - 1e-4 for d, e in ((0.05, (0, 0)), (-0.05, (0, 0)), (0, (0.05, 0)), (0, (0, -0.05))))


def test_cut():
    assert toxicity.best_cut(np.array([0.1, 0.2, 0.9, 1.0]), np.array([False, False, True, True])) == 0.55
    assert toxicity.best_cut(np.array([0.5, 0.5]), np.array([False, False])) > 0.5


def test_held_out_accuracy_and_odd_rows(spark):
    clean, bad = ["river", "stone", "window", "garden", "letter", "morning"], ["vequain", "vequor"]
    rows, labels = [], []
    for k in range(900):
        words = [clean[(k * 7 + i * i) % 6] for i in range(5 + k % 40)]
        toxic = k % 5 == 0
        if toxic:
            words[:: 4 if k % 2 else 2] = [bad[k % 2]] * len(words[:: 4 if k % 2 else 2])
        rows.append((k, " ".join(words), 1.0))
        if k < 600:
            labels.append((k, int(toxic), None))
    rows += [(900, None, None), (901, "", 2.0), (902, "vequain " * 50_000, 1.0), (None, "river", 1.0), (0, rows[0][1], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity double")
    table = spark.createDataFrame([*labels, (None, 1, ""), (5, None, "")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, table)
    assert len(model.thresholds) == 2
    out = toxicity.scored(docs, model).collect()
    assert all(r["toxic"] == (r["doc_id"] is not None and (r["doc_id"] < 900 and r["doc_id"] % 5 == 0 or r["doc_id"] == 902)) for r in out) and len(out) == len(rows)
    kept = toxicity.without_toxic(docs, table)
    assert kept.columns == docs.columns and kept.count() == 720 + 3
    nothing = toxicity.fit(docs, table.limit(0))
    assert {(r["severity"], r["toxic"]) for r in toxicity.scored(docs, nothing).collect()} == {(0.0, False)}
    assert toxicity.without_toxic(docs.limit(0), table).count() == 0
