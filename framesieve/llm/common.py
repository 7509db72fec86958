"""Shared helpers: the shared scratch folder, checked broadcasts and Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a table may be broadcast; beyond either, a shuffled join is used.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset, and the session is local, a temporary folder is set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext._jsc.sc()
    if not found and context.getCheckpointDir().isDefined():
        found = context.getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="framesieve-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/framesieve-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended, and its folder is the cluster's to clean
        return


def stored(df: DataFrame, name: str, codec: str = "zstd", **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns the table that was read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """Marks df for a broadcast if its rows and bytes, measured here, are few; df has to be stored already."""
    rows, size = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if size is None else size
    text = [F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns]
    total = text[0]
    for c in text[1:]:
        total = total + c
    n, width = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and width <= size else df


def dealt_join(left: DataFrame, right: DataFrame, on: Column, spread: Column, how: str = "inner", salts: int = 32) -> DataFrame:
    """left joined with right, of which it has one row a key at most, however many rows of left have one key.

    A small right side, counted here, is broadcast; else its rows are repeated for each of ``salts`` shares into which
    ``spread``, a column of left, deals left's rows. right has to be stored already.
    """
    marked = maybe_broadcast(right)
    if marked is not right:
        return left.join(marked, on, how)
    both = [*left.columns, *right.columns]
    own, other = fresh(both, "__salt__"), fresh(both, "__deal__")
    dealt = left.withColumn(own, F.pmod(F.xxhash64(spread), F.lit(salts)))
    wide = right.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    # Spark sizes the repeated rows as the file that they come from, and would broadcast them on the driver.
    return dealt.join(wide.hint("merge"), on & (F.col(own) == F.col(other)), how).drop(own, other)


def row_hash(df: DataFrame) -> Column:
    """A hash of all of a row's columns."""
    return F.xxhash64(*[F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema])


def fresh(df: DataFrame | list[str], name: str) -> str:
    """A column name starting with name that df, or a list of names, doesn't have."""
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str | int, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has about budget bytes of column at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + budget, side="right")))
            yield batch.slice(start, end - start)
            start = end


def mapped(docs: DataFrame, keep: Sequence[str], column: str, each: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], added: Sequence[tuple[str, T.DataType | str]]) -> DataFrame:
    """docs' columns ``keep`` and the added ones that each makes of batches of ``keep`` and ``column``, in this order.

    Within, columns go by their places alone, so that their names may be anything.
    """
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate([*keep, column])])
    schema = T.StructType(source.schema.fields[: len(keep)])
    for k, (_, kind) in enumerate(added):
        schema = schema.add(f"x{k}", kind)
    names = list(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in each(batches):
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema).toDF(*keep, *[name for name, _ in added])


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of each text, without decoding it."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
