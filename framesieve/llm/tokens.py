"""Token ids as Parquet: list columns, dictionary or delta encoding, small pages and a page index.

Rows are in ascending key order over all files, each row knows its file's part and its place in
tokens within it, so that one document, a range of documents or the counts alone can be read
without the ids of the others.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, scratch_path, slices

#: Id that ends a document.
END_ID = 2
IDS_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: Row groups of 32 MB with pages of 64 KB: the page index then finds a document's ids in a few pages.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 64 << 10, 2_000
#: New words and pieces after which a worker forgets those before the last so many.
REMEMBERED = 500_000


class Encoder:
    """A byte-level BPE tokenizer of the tokenizers library that looks words up it has met before.

    Its pre-tokenizer always cuts before a single space between two characters that aren't white space, so
    the parts between such spaces are encoded on their own. A part of Latin letters, digits, other ASCII
    signs but the apostrophe, and single line ends is cut further, as its pre-tokenizer would, and its pieces
    go to the library's BPE model. Anything else goes through the whole library, as do texts that
    hold one of its added tokens.
    """

    _piece = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+|\n(?=\\S)")
    _space = re.compile(r"(?<=\S) (?=\S)")
    _odd = re.compile(r" \s|\s ")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        state = json.loads(self.whole.to_str())
        pre = state["pre_tokenizer"] or {}
        #: What is said above holds for this pre-tokenizer alone; with any other, all goes through the whole library.
        self.cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not state["normalizer"] and not state["truncation"] and not state["padding"] and state["model"]["type"] == "BPE"
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = (b for b in range(256) if b not in set(kept))
        self.letters = {b: b for b in kept} | {b: 256 + n for n, b in enumerate(other)}
        self.model = self.whole.model
        #: Little-endian 32-bit ids of words, with the space before them, met lately and before that.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _of_piece(self, piece: str) -> bytes:
        """Ids of one of the pre-tokenizer's pieces."""
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        return array("i", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _of_rest(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            found = self.pieces[piece] = self._of_piece(piece)
        return found

    def _of_part(self, part: str) -> bytes:
        """Ids of a part of a text, with the space before it if it has one."""
        start = part.startswith(" ")
        pieces = self._piece.findall(part, start)
        if not pieces or sum(map(len, pieces)) + start != len(part):
            return array("i", self.whole.encode(part, add_special_tokens=False).ids).tobytes()
        if not start:
            return b"".join(map(self._of_rest, pieces))
        if len(pieces) == 1:
            return self._of_piece(part)
        return self._of_word(pieces[0]) + b"".join(map(self._of_rest, pieces[1:]))

    def _of_word(self, word: str) -> bytes:
        """Ids of a space and word. What hasn't been met among the last REMEMBERED new words is forgotten."""
        found = self.words.get(word) or self.older.get(word) or self._of_part(" " + word)
        if len(word) <= 64:
            if len(self.words) >= REMEMBERED:
                self.words, self.older = {}, self.words
            self.words[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """Ids of text as little-endian 32-bit numbers."""
        if not text:
            return b""
        if not self.cut or any(t in text for t in self.added):
            return array("i", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if text[0].isspace() or text[-1].isspace() or self._odd.search(text):
            first, *parts = self._space.split(text)
            return self._of_part(first) + b"".join([self._of_part(" " + p) for p in parts])
        first, *words = text.split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            found = [self._of_word(w) if x is None else x for w, x in zip(words, found, strict=True)]
        return self._of_part(first) + b"".join(found)


_encoders: dict[str, Encoder] = {}


def _encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encoder(tokenizer_path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start, end = _encoder_of(tokenizer_path), TaskContext.get().partitionId(), 0, struct.pack("<i", end_id)
        for batch in slices(batches, "text", 2 << 20):
            ids = [encoder.ids(t or "") + end for t in batch.column("text").to_pylist()]
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            ends = np.cumsum(n)
            flat = np.frombuffer(b"".join(ids), dtype="<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(start + ends - n), pa.array(n), lists], schema=_ARROW)
            start += int(ends[-1])

    return encode


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID, encoding: str = "dictionary") -> None:
    """Encodes every whole text (null: empty), ends it with end_id and writes the ids to path in ascending key order.

    Null keys come first; rows with one key are in the order of their texts. ``encoding`` is "dictionary"
    (bit-packed indexes of each row group's distinct ids) or "delta" (DELTA_BINARY_PACKED).
    An empty table gives a table without rows; other columns are ignored.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding: {encoding}")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # Ids first and a hash of the text next: rows that share a key can still be dealt out.
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ids = rows.mapInArrow(_encoder(tokenizer_path, end_id), IDS_SCHEMA)
    options = {"compression": "snappy", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": str(encoding == "dictionary").lower()}
    if encoding == "delta":
        options["parquet.writer.version"] = "PARQUET_2_0"
    ids.write.options(**options).parquet(path)


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a written table; start counts the ids of all documents before it.

    Only the counts are read to place documents; ids are read if asked for.
    """
    table = spark.read.schema(IDS_SCHEMA).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each written file.
    before = parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")).checkpoint()
    placed = table.join(maybe_broadcast(before), F.col("part") == F.col("p"))
    return placed.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", *["ids"] * with_ids)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, ends = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4")), lists.offsets.to_numpy()
        crc = [zlib.crc32(memoryview(flat[a:b]).cast("B")) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files in path; the checksum is over little-endian 32-bit ids."""
    return read_token_ids(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer_path: str, **options: str) -> DataFrame:
    """Writes docs' token ids to the shared folder, reads the files back and returns their digests."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_ids(docs, path, tokenizer_path, **options)
    return token_digests(docs.sparkSession, path)
