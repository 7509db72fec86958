"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model has the bytes of UTF-8 as symbols, runs of white space as one space, and one document as a sentence, so that n-grams run
over the borders of words. Texts are cut into chunks of whole documents, and each n-gram of a chunk is listed once. Counts of trusted text are
summed by hash shards; lower orders, discounts, interpolated probabilities and back-off weights follow by joins of the count
tables. The chunks' n-grams meet these tables in joins, whatever the model's size, and the values return to their
chunks, where each document is summed. As an n-gram occurs once a chunk, no common one is a hot key. A document's
perplexity is over all its symbols and its end. It is kept if that isn't above a quantile of the perplexities of its
language's trusted documents that were held out of the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt_join, maybe_broadcast, raw_texts, slices, stored

#: Symbols in an n-gram; up to 7 fit into a number.
ORDER = 4
#: A document may be as perplexing as all but so small a share of its language's trusted documents.
QUANTILE = 0.995
#: Perplexities are counted in bins of this width of their logarithm.
BIN = 0.001
#: Bytes of one language after which a chunk ends with its document, of all languages' open chunks, and n-grams in a row of a chunk's list.
CHUNK, OPEN, LISTED = 8 << 20, 32 << 20, 8192
#: One of so many trusted documents sets the thresholds and isn't in the model.
HELD_OUT = 5
#: Trusted keys (a number each) up to which they are broadcast.
KEY_ROWS = 1_000_000
#: Shares that a common context's rows are dealt into.
SALTS = 8
#: Sentence marks; neither is a byte of UTF-8.
BEGIN, END = b"\xff", b"\xfe"


class Chunk:
    """Documents of one language."""

    def __init__(self) -> None:
        self.docs: list[bytes] = []
        self.keys: list[pa.Array] = []
        self.size = 0

    def add(self, key: pa.Array, text: bytes) -> None:
        self.docs.append(b" ".join(text.split()))
        self.keys.append(key)
        self.size += len(self.docs[-1]) + 1

    def lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.docs), np.int64, len(self.docs))


def grams(data: bytes, lengths: np.ndarray, order: int) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The n-gram that ends at each symbol and end of documents with any symbols, and each document's first place.

    An n-gram is a number with its symbols as bytes; those not met before follow those met.
    """
    lengths = lengths[lengths > 0]
    spans = lengths + order
    ends = np.cumsum(spans)
    symbols = np.full(int(ends[-1]) if len(ends) else 0, BEGIN[0], np.uint8)
    ours = np.ones(len(symbols), bool)
    for k in range(order - 1):
        ours[ends - spans + k] = False
    symbols[ends - 1] = END[0]
    text = ours.copy()
    text[ends - 1] = False
    symbols[text] = np.frombuffer(data, np.uint8)
    codes = np.zeros(len(symbols), "<i8")
    places = codes.view(np.uint8).reshape(-1, 8)
    for k in range(order):
        places[k:, k] = symbols[: len(symbols) - k]
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    return pc.dictionary_encode(pa.array(codes[ours])), starts


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Chunk]]:
    open_: dict[str, Chunk] = {}
    size = 0
    for batch in slices(batches, "text"):
        keys = batch.column("key")
        for k, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), raw_texts(batch.column("text")), strict=True)):
            chunk = open_.setdefault(lang, Chunk())
            before = chunk.size
            chunk.add(keys.slice(k, 1), text or b"")
            size += chunk.size - before
            if chunk.size > CHUNK:
                size -= chunk.size
                yield lang, open_.pop(lang)
            elif size > OPEN:
                yield from open_.items()
                open_, size = {}, 0
    yield from open_.items()


def count_ngrams(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, c): n-grams of all of trusted's rows (key, lang, text) and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk in _chunks(batches):
            found, _ = grams(b"".join(chunk.docs), chunk.lengths(), order)
            counts = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)).astype(np.int64)
            for start in range(0, len(counts), 100_000):
                own = found.dictionary.slice(start, 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), own, pa.array(counts[start : start + 100_000])], names=["lang", "gram", "c"])

    return trusted.select("key", "lang", "text").mapInArrow(run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified discounts from the counts of counts; a half of the count where these are missing."""
    n = counts.groupBy("lang").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usual = [k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}") for k in (1, 2, 3)]
    known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    return n.select("lang", *[F.when(known, F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), d))).otherwise(k / 2).alias(f"d{k}") for k, d in zip((1, 2, 3), usual, strict=True)])


def _last(gram: Column | str, k: int) -> Column:
    """The last k symbols of a gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << (8 * k)) - 1).cast("long"))


def _matched(left: DataFrame, right: DataFrame, own: Column, how: str = "inner") -> DataFrame:
    """left (lang, gram, ...) with the row of right (of_lang, of_gram, ...), which is stored, whose gram is ``own``."""
    same = (F.col("lang") == F.col("of_lang")) & (own == F.col("of_gram"))
    return dealt_join(left, right, same, F.col("gram"), how, SALTS).drop("of_lang", "of_gram")


def build_model(counts: DataFrame, order: int = ORDER) -> dict[int, DataFrame]:
    """For k up to order, stored: (of_lang, of_gram, p, b) of grams of k symbols, from counts of the highest order.

    p is the logarithm of the interpolated probability of a gram's last symbol after the others, b that of its
    back-off weight as a context; either may be null. The row of 0 symbols has an unknown symbol's p.
    """
    tables = [stored(counts, "kn-counts")]
    for k in range(order - 1, 0, -1):
        tables.append(stored(tables[-1].groupBy("lang", _last("gram", k).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "kn-counts"))
    parts: dict[int, list[DataFrame]] = {k: [] for k in range(order + 1)}
    below: DataFrame | None = None
    none = F.lit(None).cast("double")
    for k, table in enumerate(reversed(tables), 1):
        t = table.join(maybe_broadcast(_discounts(table).checkpoint()), "lang")
        t = t.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = F.shiftright("gram", 8)
        contexts = stored(t.groupBy(F.col("lang").alias("of_lang"), context.alias("of_gram")).agg(F.sum("c").alias("total"), F.sum("d").alias("spared"), F.count(F.lit(1)).alias("kinds")), "kn-contexts")
        t = _matched(t.select("lang", "gram", (F.col("c") - F.col("d")).alias("left")), contexts, context)
        weight = F.col("spared") / F.col("total")
        if below is None:
            # Below single symbols, all are alike; one more than seen stands for the unknown.
            t = t.withColumn("p", F.col("left") / F.col("total") + weight / (F.col("kinds") + 1))
            parts[0].append(contexts.select("of_lang", "of_gram", F.log(weight / (F.col("kinds") + 1)).alias("p"), none.alias("b")))
        else:
            t = _matched(t, below.withColumnRenamed("p", "q"), _last("gram", k - 1)).withColumn("p", F.col("left") / F.col("total") + weight * F.col("q"))
            parts[k - 1].append(contexts.select("of_lang", "of_gram", none.alias("p"), F.log(weight).alias("b")))
        below = stored(t.select(F.col("lang").alias("of_lang"), F.col("gram").alias("of_gram"), "p"), "kn-below")
        parts[k].append(below.select("of_lang", "of_gram", F.log("p").alias("p"), none.alias("b")))
    model = {}
    for k, both in parts.items():
        rows = both[0] if len(both) == 1 else both[0].unionByName(both[1]).groupBy("of_lang", "of_gram").agg(F.max("p").alias("p"), F.max("b").alias("b"))
        model[k] = stored(rows, "kn-model")
    return model


def gram_scores(found: DataFrame, model: dict[int, DataFrame]) -> DataFrame:
    """(lang, gram, score) of grams (lang, gram) of the highest order, by backing off from the longest that the model has."""
    left, out = found.withColumn("score", F.lit(0.0)), None
    for k in range(max(model), -1, -1):
        p = model[k].filter("p IS NOT NULL").drop("b")
        t = stored(_matched(left, p, _last("gram", k), "left"), "kn-met")
        done = t.filter("p IS NOT NULL").select("lang", "gram", (F.col("score") + F.col("p")).alias("score"))
        if not k:
            return done if out is None else out.unionByName(done)
        out = done if out is None else out.unionByName(done)
        left = t.filter("p IS NULL").drop("p")
        if k > 1:
            weights = model[k - 1].filter("b IS NOT NULL").drop("p")
            left = _matched(left, weights, F.shiftright(_last("gram", k), 8), "left").withColumn("score", F.col("score") + F.coalesce("b", F.lit(0.0))).drop("b")
    raise AssertionError


def chunked(rows: DataFrame, order: int) -> DataFrame:
    """Rows (key, lang, text) as chunks: one row with keys, lengths and packed texts, and rows (first, grams) of listed n-grams."""
    number = F.lit(0).cast("long")
    schema = rows.select(number.alias("chunk"), "lang", number.alias("first"), F.array(number).alias("grams"), F.array("key").alias("keys"), F.lit(b"").alias("lengths"), F.lit(b"").alias("texts")).schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for at, (lang, chunk) in enumerate(_chunks(batches)):
            lengths, names, data = chunk.lengths(), pa.concat_arrays(chunk.keys), b"".join(chunk.docs)
            types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(names.type), pa.binary(), pa.binary()]
            whole = [part + at, lang, len(data), None, None, lengths.astype("<i8").tobytes(), pa.Codec("zstd", compression_level=12).compress(data, asbytes=True)]
            arrays = [pa.array([x], t) for x, t in zip(whole, types, strict=True)]
            arrays[4] = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            found = grams(data, lengths, order)[0].dictionary
            firsts = np.arange(0, len(found), LISTED)
            same = len(firsts)
            lists = pa.ListArray.from_arrays(pa.array([*firsts.tolist(), len(found)], pa.int32()), found)
            made = [pa.array([part + at] * same, types[0]), pa.array([lang] * same, types[1]), pa.array(firsts, types[2]), lists]
            yield pa.RecordBatch.from_arrays([*made, *[pa.nulls(same, t) for t in types[4:]]], names=schema.names)

    return rows.select("key", "lang", "text").mapInArrow(run, schema)


def _scorer(order: int):
    """Sums of one chunk, of its row and the values of its n-grams."""

    def run(chunk: pa.Table, values: pa.Table) -> pa.Table:
        keys = pa.concat_arrays([c.flatten() for c in chunk.column("keys").chunks])
        lengths = np.frombuffer(chunk.column("lengths")[0].as_py(), "<i8")
        symbols = np.where(lengths > 0, lengths + 1, 0)
        sums = np.zeros(len(lengths))
        if len(values):
            data = pa.Codec("zstd").decompress(chunk.column("texts")[0].as_py(), chunk.column("first")[0].as_py(), asbytes=True)
            found, starts = grams(data, lengths, order)
            score = np.zeros(len(found.dictionary))
            score[values.column("at").to_numpy()] = values.column("score").to_numpy()
            sums[lengths > 0] = np.add.reduceat(score[found.indices.to_numpy()], starts)
        blank = np.full(len(sums), not len(values))
        return pa.table({"key": keys, "lang": pa.array([chunk.column("lang")[0].as_py()] * len(lengths), pa.string()), "loglik": pa.array(sums, pa.float64(), mask=blank), "symbols": pa.array(symbols, pa.int64())})

    return run


def scores(rows: DataFrame, model: dict[int, DataFrame], order: int = ORDER) -> DataFrame:
    """(key, lang, loglik, symbols) of rows (key, lang, text); loglik is null in a language that model lacks."""
    parts = stored(chunked(rows, order), "kn-chunks")
    listed = parts.filter("grams IS NOT NULL").select("chunk", "lang", "first", F.posexplode("grams").alias("at", "gram"))
    listed = listed.select(F.col("chunk").alias("of_chunk"), "lang", (F.col("first") + F.col("at")).alias("at"), "gram")
    known = stored(gram_scores(listed.select("lang", "gram").distinct(), model), "kn-gram-scores")
    values = listed.join(known, ["lang", "gram"]).select("of_chunk", "at", "score")
    whole = parts.filter("keys IS NOT NULL").select("chunk", "lang", "first", "keys", "lengths", "texts")
    schema = rows.select("key", "lang").schema.add("loglik", "double").add("symbols", "long")
    return whole.groupBy("chunk").cogroup(values.groupBy("of_chunk")).applyInArrow(_scorer(order), schema)


def thresholds(perplexities: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold) from trusted documents' (lang, perplexity): the upper edge of the bin that holds the quantile.

    It is at most exp(BIN) times the quantile itself. Equal perplexities share a bin, languages without any have no row.
    """
    bins = perplexities.groupBy("lang", F.floor(F.log("perplexity") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("lang").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
    return bins.filter(F.col("upto") >= quantile * F.col("total")).groupBy("lang").agg(F.exp((F.min("bin") + 1) * BIN).alias("threshold"))


def held_out(key: Column) -> Column:
    """Whether a trusted key is kept from the model, so that its text can set the threshold: about one in HELD_OUT."""
    return F.pmod(F.xxhash64(key, F.lit("held")), F.lit(HELD_OUT)) == 0


def quality(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """(key, lang, perplexity, threshold, kept) of each row; trusted has the keys of trusted rows.

    A null language is the language ''. Null or blank texts have no perplexity and aren't kept. In a
    language without trusted text nothing can be judged: perplexity and threshold are null, texts are kept. Repeated
    rows stay, trusted keys count once, rows with a null key aren't trusted; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang"), F.col(f"`{text}`").alias("text"))
    keys = trusted.select(F.col(f"`{key}`").alias("trusted")).filter("trusted IS NOT NULL").distinct().checkpoint()
    known = maybe_broadcast(keys, KEY_ROWS, 40 * KEY_ROWS)
    counts = count_ngrams(rows.filter(~held_out(F.col("key"))).join(known, F.col("key") == F.col("trusted"), "left_semi"), order)
    model = build_model(counts, order)
    scored = scores(rows, model, order)
    perplexity: Column = F.when(F.col("symbols") > 0, F.exp(-F.col("loglik") / F.col("symbols")))
    scored = stored(scored.select("key", "lang", perplexity.alias("perplexity"), F.col("symbols")), "kn-scores")
    judged = scored.filter("perplexity IS NOT NULL").join(known, F.col("key") == F.col("trusted"), "left_semi")
    own = thresholds(judged.filter(held_out(F.col("key"))), quantile)
    # A language of which no trusted document was held out has its threshold from those of the model.
    level = own.unionByName(thresholds(judged, quantile).join(own.select("lang"), "lang", "left_anti")).checkpoint()
    kept = F.when(F.col("symbols") == 0, False).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return scored.join(maybe_broadcast(level), "lang", "left").select(F.col("key").alias(key), F.col("lang").alias(lang), "perplexity", "threshold", kept.alias("kept"))
