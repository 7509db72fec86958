import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framesieve.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_library():
    library, encoder = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    assert encoder.cut
    rng = random.Random(8)
    atoms = ["a", "The", "ing", "é", "ñÑ", " ", "  ", "\n", "\n\n", "\t", ".", ",!", "'s", "'", "don't", "12", "3²", "漢", "😀", "_", "$$$", "|", "ß", "<|endoftext|>", "\xa0", "\x1c", " ", "ǅ", "Ω", "#", "\\", "]", "^"]
    texts = ["", " ", "\n", " a", "a ", "a b"] + ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 25))) for _ in range(6000)]
    for t in texts:
        assert np.frombuffer(encoder.ids(t), dtype="<i4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def brute(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files(spark, tmp_path, encoding):
    rows = [(k, f"text {k} of  many\nwords " * (k % 7), 0, "x") for k in range(400, 0, -1)] + [(401, None, 1, None), (402, "long text " * 30_000, 2, ""), (None, "no key", 3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string")
    path = str(tmp_path / encoding)
    tokens.write_token_ids(docs, path, PATH, encoding=encoding)
    want = brute([r[:2] for r in rows])
    assert sorted(map(tuple, tokens.token_digests(spark, path).collect()), key=lambda r: r[1]) == want
    assert tokens.read_token_ids(spark, path, with_ids=False).columns == ["doc_id", "start", "n_tokens"]
    used = set()
    for f in (tmp_path / encoding).glob("part-*.parquet"):
        column = [c for c in (pq.ParquetFile(f).metadata.row_group(0).column(k) for k in range(5)) if c.path_in_schema.startswith("ids")][0]
        used |= set(column.encodings)
        assert column.has_offset_index and column.has_column_index
    assert ("DELTA_BINARY_PACKED" in used) == (encoding == "delta") and (("RLE_DICTIONARY" in used) or ("PLAIN_DICTIONARY" in used)) == (encoding == "dictionary")


def test_no_rows_and_repeated_keys(spark):
    docs = spark.createDataFrame([(5, "b"), (5, "a"), (5, "a")], "doc_id long, text string")
    got = sorted(map(tuple, tokens.tokenized(docs, PATH).collect()), key=lambda r: r[1])
    assert [r[:3] for r in got] == [(5, 0, 2), (5, 2, 2), (5, 4, 2)]
    assert tokens.tokenized(docs.limit(0), PATH).count() == 0


def test_query_matches_brute_force(spark):
    from framesieve.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op9_token_ids"](spark, sf).collect())) == brute(rows)
