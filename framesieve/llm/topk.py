"""Exact top-k by inner product: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds.

Candidates are stored by descending length, so that those of a chunk are about as long; results don't depend on it, as
Spark reads files again in an order of its own. The eigenvectors of their Gram matrix (the right singular
vectors of the whole matrix) rotate vectors so that the first components hold most of their length.
With the partial sum over these, and the lengths of what is left, a pair's score is bounded; only pairs whose
bound reaches the query's k-th best score so far are computed, in whole numbers. Queries go in blocks of
bounded size, each block to all candidates; only the best of each task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, stored

#: Queries in a block, candidates compared at a time, longest vectors that give the first bounds.
QUERY_BLOCK, CHUNK, SEEDS = 4096, 1024, 4096
#: Rounding of a partial sum, as a share of the product of both lengths.
SLACK = 1e-9
_PREPARED = "vec_id long, size int, norm double, v binary"


def _prepare(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vector is None or any(x is None for x in vector):
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * np.array(vector, dtype=np.float64))
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        rows.append((key, len(x), float(np.sqrt((x * x).sum())), _packed(x)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.float64(), pa.binary()), strict=True)], names=["vec_id", "size", "norm", "v"])

    return run


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers below 2**15 in two bytes each, others as doubles."""
    small = x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x
    return small.astype("<i2" if small.dtype == np.int16 else "<f8").tobytes()


def _matrix(vectors: list[bytes], sizes: list[int], width: int) -> np.ndarray:
    """Rows of doubles; missing components at the end are 0."""
    out = np.zeros((len(vectors), width))
    for k, (v, n) in enumerate(zip(vectors, sizes, strict=True)):
        if n:
            out[k, :n] = np.frombuffer(v, dtype="<i2" if len(v) == 2 * n else "<f8")
    return out


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = _matrix(b.column("v").to_pylist(), b.column("size").to_pylist(), width)
            lengths = np.linalg.norm(x, axis=1)
            x = x[np.isfinite(lengths) & (lengths > 0)] / lengths[np.isfinite(lengths) & (lengths > 0), None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    return run


def _added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(r) for r in rows["row"])
    return pd.DataFrame({"i": [key[0]], "row": [np.asarray(total).tobytes()]})


def rotation(prepared: DataFrame, width: int) -> np.ndarray:
    """Orthogonal width x width matrix, its columns by descending share of all vectors' length."""
    rows = prepared.mapInArrow(_gram(width), "i int, row binary").groupBy("i").applyInPandas(_added, "i int, row binary").collect()
    gram = np.zeros((width, width))
    for r in rows:
        gram[r["i"]] = np.frombuffer(r["row"])
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _fits(q: np.ndarray, v: np.ndarray) -> bool:
    """Whether doubles hold all sums exactly."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < 2.0**53


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row inner products of whole numbers, as int64; beyond its range the nearest value."""
    if _fits(q, v):
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, v, strict=True)]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], dtype=np.int64)


class _Best:
    """The k best (score, vec_id) of each query so far, and the score that the next one has to reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor, self.held, self.n = k, floor.astype(np.float64), [], 0

    def add(self, q: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        self.held.append((q, score, vec_id))
        self.n += len(q)
        if self.n > 200_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, s, v = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((v, ~s, q))  # ~s: descending, without overflow
        q, s, v = q[order], s[order], v[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        keep = place < self.k
        self.held, self.n = [(q[keep], s[keep], v[keep])], 0
        return self.held[0]


def _chunk(best: _Best, q: dict, vec_ids: np.ndarray, v: np.ndarray, norms: np.ndarray, r: np.ndarray, head: int) -> None:
    """Adds what q's queries find among v, whose rows may be in any order."""
    with np.errstate(all="ignore"):
        # Queries that the longest of these can't serve; later chunks may hold longer ones.
        ids = np.flatnonzero(~(q["norm"] * norms.max(initial=0) * (1 + SLACK) < best.floor))
        if not len(ids):
            return
        turned = v @ r
        rest = np.sqrt((turned[:, head:] ** 2).sum(1))
        bound = q["turned"][ids, :head] @ turned[:, :head].T + q["rest"][ids, None] * rest
        bound += SLACK * q["norm"][ids, None] * norms + 1e-6
        near = ~(bound < best.floor[ids, None])
        del bound
        if near.mean() > 0.05 and _fits(q["v"], v):  # one product of matrices costs less than many pairs
            near &= q["v"][ids] @ v.T >= best.floor[ids, None]
        rows, cols = np.nonzero(near)
    for a in range(0, len(rows), 1 << 16):
        x, y = ids[rows[a : a + (1 << 16)]], cols[a : a + (1 << 16)]
        other = q["vec_id"][x] != vec_ids[y]
        x, y = x[other], y[other]
        score = exact_scores(q["v"][x], v[y])
        high = score >= best.floor[x]
        best.add(x[high], score[high], vec_ids[y[high]])
    best.cut()


def _search(shared, k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best, r, head = _Best(q["floor"], k), q["rotation"], q["head"]
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                b = batch.slice(a, CHUNK)
                v = _matrix(b.column("v").to_pylist(), b.column("size").to_pylist(), width)
                _chunk(best, q, b.column("vec_id").to_numpy(), v, b.column("norm").to_numpy(), r, head)
        at, score, vec_id = best.cut()
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(q["vec_id"][at]), pa.array(q["number"][at]), pa.array(vec_id), pa.array(score)], names=["query_id", "query", "vec_id", "score"])

    return run


def _head(eigen_share: np.ndarray) -> int:
    """Components that hold nine tenths of the length, in eights; all but an eighth at most."""
    width = len(eigen_share)
    need = int(np.searchsorted(np.cumsum(eigen_share), 0.9)) + 1
    return max(1, min((need + 7) // 8 * 8, width - width // 8)) if width else 0


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with is_query, the k highest inner products with rows of other keys.

    Components become floor(scale * x), scores are whole numbers, ties go to the smaller key, rank starts
    at 1. Null vectors, and those that hold null or non-finite components, take no part, nor do rows whose key is
    null. A shorter vector counts as ended by zeros. Repeated queries (key and vector) count once, repeated
    candidates each. Fewer candidates give fewer rows, an empty table none; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("embedding"))
    prepared = rows.mapInArrow(_prepare(scale), _PREPARED)
    order = [F.col("norm").desc(), F.col("vec_id")]
    prepared = stored(prepared.repartitionByRange(*order).sortWithinPartitions(*order), "topk")
    wanted = vectors.filter(is_query & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("embedding"))
    queries = stored(wanted.mapInArrow(_prepare(scale), _PREPARED).distinct(), "topk-queries")
    n, width = prepared.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    n_queries = queries.count()
    path, schema = scratch_path(spark, "topk-best"), "query_id long, query long, vec_id long, score long"
    turn = rotation(prepared, width) if n and width else np.zeros((width, width))
    seeds = prepared.orderBy(*order).limit(SEEDS).collect()
    seed_ids, seed = np.array([r["vec_id"] for r in seeds], dtype=np.int64), _matrix([r["v"] for r in seeds], [r["size"] for r in seeds], width)
    with np.errstate(all="ignore"):
        energy = np.nan_to_num((seed @ turn) ** 2, posinf=0).sum(0) if len(seeds) else np.ones(width)
    head = _head(energy / max(energy.sum(), 1e-300))
    blocks = -(-n_queries // QUERY_BLOCK)
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == block).collect()
        if not part:
            continue
        q = {"vec_id": np.array([r["vec_id"] for r in part], dtype=np.int64), "number": np.arange(len(part), dtype=np.int64) * blocks + block, "norm": np.array([r["norm"] for r in part])}
        q["v"] = _matrix([r["v"] for r in part], [r["size"] for r in part], width)
        with np.errstate(all="ignore"):
            q["turned"] = q["v"] @ turn
            q["rest"] = np.sqrt((q["turned"][:, head:] ** 2).sum(1))
        q |= {"rotation": turn, "head": head, "floor": np.full(len(part), -np.inf)}
        first = _Best(q["floor"], k)
        for a in range(0, len(seeds), CHUNK):
            _chunk(first, q, seed_ids[a : a + CHUNK], seed[a : a + CHUNK], np.array([r["norm"] for r in seeds[a : a + CHUNK]]), turn, head)
        # Candidates that reach the k-th best of the longest vectors are found again among all.
        q["floor"] = first.floor
        shared = spark.sparkContext.broadcast(q)
        prepared.mapInArrow(_search(shared, k, width), schema).write.mode("append").parquet(path)
        shared.unpersist()
    best = spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), F.col("vec_id"))))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
