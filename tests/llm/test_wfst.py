import random

import public_tokenizers
import pytest
import sentencepiece

from framesieve.llm import wfst

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab the ing er  ▁\n\té漢😀.,!-0123THE "


def texts(n, seed):
    rng = random.Random(seed)
    return ["", " ", "a", " " * 70, "x" * 300, "word  " * 50, "\x00 �"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def as_unigram(data):
    """The same pieces and scores, read as a unigram model."""
    at = data.index(b"\x12\x06tok_v0\x18\x02")
    return data[: at + 9] + b"\x01" + data[at + 10 :]


def with_varint(data, old, new):
    assert data.count(old) == 1
    return data.replace(old, new)


@pytest.mark.parametrize("unigram", [False, True])
def test_equals_the_library(unigram):
    data = open(PATH, "rb").read()
    data = as_unigram(data) if unigram else data
    model, library = wfst.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert model.kind == (wfst.UNIGRAM if unigram else wfst.BPE)
    for t in texts(3000, 4):
        ids = model.encode(t)
        assert ids == library.encode(t), t
        assert model.decode(ids) == library.decode(ids) == t.replace("▁", " ")


def test_shortest_path_equals_all_paths():
    model = wfst.Model(as_unigram(open(PATH, "rb").read()))

    def least(part, at=0):
        return 0.0 if at == len(part) else min(w + least(part, end) for end, w in model.arcs(part, at))

    rng = random.Random(2)
    for _ in range(200):
        part = "▁" + "".join(rng.choice("thering漢") for _ in range(9))
        path, at, cost = model.path(part), 0, 0.0
        for piece in path:
            cost += dict(model.arcs(part, at))[at + len(piece)]
            at += len(piece)
        assert at == len(part) and cost == least(part)


def test_long_merges_equal_short():
    model = wfst.load(PATH)
    for t in texts(300, 9):
        t = t.replace(" ", "▁")
        assert model._merged_short(list(t)) == model.merged(t)


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "Some text.\nMore", "z"), (None, " two  spaces " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = wfst.encoded(docs, PATH, check="exact")
    assert out.columns == ["doc_id", "ids", "exact"] and all(r["exact"] for r in out.collect())
    back = {(r["doc_id"], r["text"]) for r in wfst.decoded(out, PATH).collect()}
    assert back == {(k, t or "") for k, t, _ in rows}
    assert wfst.encoded(docs.limit(0), PATH).count() == 0
