"""The pipeline against plain Python, stage by stage, at the smallest size."""

import corpus_pipeline as cp
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_mixing import brute as brute_mix
from test_simhash import brute_components, brute_fingerprint

from framesieve.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    steps = [docs]
    for _, stage in cp.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    toxic = {r["doc_id"] for r in toxicity.scored(docs, toxicity.fit(docs, labels)).filter("toxic").collect()}
    rows = [{r["doc_id"]: r for r in s.collect()} for s in steps[:4]]
    assert all(s.columns == docs.columns for s in steps[:5])
    assert set(rows[1]) == set(rows[0]) - toxic
    prints = [(k, brute_fingerprint(r["text"])) for k, r in rows[1].items()]
    assert set(rows[2]) == {c for c in brute_components(prints)}
    assert set(rows[3]) == set(rows[2]) and any(rows[3][k]["text"] != rows[2][k]["text"] for k in rows[3])
    mixed = brute_mix([(k, r["text"], r["source"]) for k, r in rows[3].items()])
    want = sorted(k for k, size, _, _, taken in mixed for _ in range(taken // size if size else 0))
    kept = steps[4].filter(F.length("text") > 0).collect()
    assert sorted(r["doc_id"] for r in kept) == want
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {r["doc_id"]: r["ids"] for r in steps[5].collect()}
    assert all(ids[k] == library.encode(rows[3][k]["text"]) for k in ids)
    assert steps[5].count() == steps[4].count()
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, steps[5].collect()))
