"""SimHash near-duplicates: a binary-trie self-join of fingerprints and its connected components.

Distinct fingerprints form a binary trie. Pairs of nodes are traversed together; bits in which the two
prefixes differ add up, and a pair is dropped once they exceed the error budget. Two tries share the work: of
two fingerprints with at most four differing bits, either the upper half differs in two at most (first trie,
upper half first), or the lower half in one at most (second trie, lower half first).

The top of each trie is dealt out as pairs of prefixes; pairs with many fingerprints are dealt by longer
prefixes. A task returns a spanning forest of what it linked, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, dealt_join, fresh, mapped, maybe_broadcast, raw_texts, row_hash, slices, stored

SEED, SHINGLE, BUDGET = 42, 4, 4
#: Fingerprints that two nodes may hold together before they are dealt by longer prefixes, and the usual number.
MOST_IN_UNIT, USUAL_IN_NODE = 1 << 20, 1 << 14
#: Bits of the first prefixes (least, most) and bits by which a crowded prefix gets longer.
FIRST_BITS, MORE_BITS = (4, 16), 8
#: Node pairs with so few fingerprint pairs are compared outright; pairs compared, and nodes held, at a time.
LEAF_PAIRS, AT_ONCE = 64, 1 << 20
#: Rows and bytes of the rows to drop up to which they are broadcast, which the driver has to hold; beyond, they are joined by their hashes.
MARKED = (BROADCAST_ROWS, BROADCAST_BYTES)
_U = np.uint64


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each word shingle; A-Z are lower-cased, words are what white space separates, repeats count."""
    words = (text or b"").lower().split()
    if not words:
        return []
    hash_of, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return [hash_of(join(words), SEED)]
    return [hash_of(join(w), SEED) for w in zip(*(itertools.islice(words, k, None) for k in range(shingle)), strict=False)]


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit fingerprint of each text: a bit is 1 if more than half of the shingles' hashes have it."""
    out = np.zeros(len(texts), dtype=_U)
    pending: list[tuple[int, list[int]]] = []
    held = 0
    for k, t in enumerate(texts):
        if found := shingle_hashes(t, shingle):
            pending.append((k, found))
            held += len(found)
        if held > 100_000:
            _vote(pending, out)
            pending, held = [], 0
    _vote(pending, out)
    return out


def _vote(pending: list[tuple[int, list[int]]], out: np.ndarray) -> None:
    if not pending:
        return
    n = np.array([len(h) for _, h in pending])
    hashes = np.fromiter(itertools.chain.from_iterable(h for _, h in pending), dtype=_U, count=int(n.sum()))
    votes = np.zeros((len(pending), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(pending)), n)
    for a in range(0, len(hashes), 1 << 17):  # a very long text is counted piece by piece
        bits = np.unpackbits(hashes[a : a + (1 << 17)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[a : a + len(bits)]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        votes[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    won = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view(_U)[:, 0]
    out[[k for k, _ in pending]] = won


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., fp): the fingerprint of each whole text as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in slices(batches, len(keep), 4 << 20):
            yield [*batch.columns[:-1], pa.array(fingerprints(raw_texts(batch.column(len(keep))), shingle).view(np.int64))]

    return mapped(docs, keep, text, each, [("fp", "long")])


# --- the traversal, within one task -------------------------------------------------------------------------


def _roots(labels: np.ndarray) -> np.ndarray:
    while (up := labels[labels] != labels).any():
        labels = np.where(up, labels[labels], labels)
    return labels


def _union(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the classes of i and j; a class is named by its smallest member."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        labels = _roots(labels)
    return labels


def link(keys: np.ndarray, left: int, depth: int, spent: int, half: int, total: int) -> np.ndarray:
    """Class labels of sorted keys; keys[:left] are under one node and keys[left:] under another (left = len: one node).

    Both nodes are ``depth`` bits deep and differ in ``spent`` bits; ``half`` bits may differ among the
    first 32 and ``total`` among all 64.
    """
    n = len(keys)
    labels = np.arange(n)
    own = left == n
    stack = [(depth, np.array([[0, left, 0 if own else left, n]], dtype=np.int64), np.array([spent], dtype=np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        d, nodes, acc = stack.pop()
        if not len(nodes):
            continue
        if len(nodes) > AT_ONCE:
            cut = len(nodes) // 2
            stack += [(d, nodes[:cut], acc[:cut]), (d, nodes[cut:], acc[cut:])]
            continue
        size = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        small = (size <= LEAF_PAIRS) | (d == 64)
        labels = _compare(keys, labels, nodes[small], total)
        nodes, acc = nodes[~small], acc[~small]
        if not len(nodes):
            continue
        if d not in ones:
            ones[d] = np.r_[0, np.cumsum((keys >> _U(63 - d)) & _U(1), dtype=np.int64)]
        c = ones[d]
        a0, a1, b0, b1 = nodes.T
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        allowed = half if d < 32 else total
        below = [np.stack([a0, am, b0, bm], 1), np.stack([am, a1, bm, b1], 1), np.stack([a0, am, bm, b1], 1), np.stack([am, a1, b0, bm], 1)]
        cost = [acc, acc, acc + 1, np.where(same, 99, acc + 1)]
        nodes, acc = np.concatenate(below), np.concatenate(cost).astype(np.int8)
        live = (acc <= allowed) & (nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2])
        stack.append((d + 1, nodes[live], acc[live]))
    return labels


def _compare(keys: np.ndarray, labels: np.ndarray, nodes: np.ndarray, total: int) -> np.ndarray:
    """Compares all keys under each pair of nodes, some pairs at a time."""
    if not len(nodes):
        return labels
    wide = nodes[:, 3] - nodes[:, 2]
    size = (nodes[:, 1] - nodes[:, 0]) * wide
    ends = np.cumsum(size)
    at = 0
    while at < len(nodes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * AT_ONCE, side="right")))
        own, first = size[at:stop], ends[at:stop] - size[at:stop]
        k = np.arange(int(own.sum())) - np.repeat(first - first[0], own)
        w = np.repeat(wide[at:stop], own)
        i, j = np.repeat(nodes[at:stop, 0], own) + k // w, np.repeat(nodes[at:stop, 2], own) + k % w
        near = np.bitwise_count(keys[i] ^ keys[j]) <= total
        near &= labels[i] != labels[j]
        labels = _union(labels, i[near], j[near])
        at = stop
    return labels


# --- dealing the top of the tries out ----------------------------------------------------------------------


def _masks(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with at most so many ones."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(range(bits), k)], dtype=_U)


def _rotated(keys: np.ndarray, trie: int) -> np.ndarray:
    return keys if trie == 0 else (keys >> _U(32)) | (keys << _U(32))


def _units(crowded: dict[tuple[int, int], dict[int, int]], bits: int, budgets: tuple[int, int], total: int, most: int):
    """mapInArrow function: fingerprints to (trie, depth, lo, hi, side, keys), keys as bytes of 64-bit numbers.

    crowded: by (trie, depth), the counts of prefixes; of the first depth all, of later ones those below crowded prefixes.
    """

    def deal(trie: int, depth: int, own: np.ndarray, other: np.ndarray, keys: np.ndarray) -> Iterator[tuple]:
        counts, above = crowded[trie, depth], crowded.get((trie, depth - MORE_BITS), {})
        order = np.lexsort((other, own))
        own, other, keys = own[order], other[order], keys[order]
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (other[1:] != other[:-1])])
        for a, b in zip(first, np.r_[first[1:], len(keys)], strict=True):
            x, y = int(own[a]), int(other[a])
            counted = depth == bits or above.get(y >> MORE_BITS, 0) > most // 2
            if counted and y not in counts:
                continue  # nothing is there
            if counts.get(x, 0) + (counts.get(y, 0) if x != y else 0) > most and (trie, depth + MORE_BITS) in crowded:
                deeper = depth + MORE_BITS
                limit = (budgets[trie] if deeper <= 32 else total) - (x ^ y).bit_count()
                sub = keys[a:b] >> _U(64 - deeper)
                facing = sub ^ (_U(x ^ y) << _U(MORE_BITS))
                for mask in _masks(MORE_BITS, min(limit, MORE_BITS)):
                    yield from deal(trie, deeper, sub, facing ^ mask, keys[a:b])
            else:
                yield trie, depth, min(x, y), max(x, y), int(x > y), keys[a:b].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in _gathered(batches):
            for trie in (0, 1):
                keys = _rotated(fp, trie)
                prefix = keys >> _U(64 - bits)
                masks = _masks(bits, min(budgets[trie], bits))
                for mask in masks:
                    rows = list(deal(trie, bits, prefix, prefix ^ mask, keys))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _UNIT_TYPES, strict=True)], names=list(_UNIT_NAMES))

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints of a partition, a million or so at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column("fp").to_numpy(zero_copy_only=False).view(_U))
        n += len(held[-1])
        if n >= AT_ONCE:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


_UNIT_NAMES = ("trie", "depth", "lo", "hi", "side", "keys")
_UNIT_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def _linker(budgets: tuple[int, int], total: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        trie, depth, lo, hi = (int(x) for x in key)
        sides = [np.sort(np.frombuffer(b"".join(rows.loc[rows.side == s, "keys"]), dtype=_U)) for s in (0, 1)]
        keys = np.concatenate(sides)
        if len(keys) < 2 or (lo != hi and not (len(sides[0]) and len(sides[1]))):
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
        spent = ((lo ^ hi) & ((1 << depth) - 1)).bit_count()
        labels = link(keys, len(sides[0]), depth, spent, budgets[trie], total)
        linked = np.flatnonzero(labels != np.arange(len(keys)))
        keys = _rotated(keys, trie).view(np.int64)
        return pd.DataFrame({"u": keys[linked], "v": keys[labels[linked]]})

    return run


def _as_dict(counts: DataFrame) -> dict[int, int]:
    return {r["prefix"]: r["n"] for r in counts.collect()}


def near_links(distinct: DataFrame, total: int = BUDGET) -> DataFrame:
    """(u, v): links that connect all of distinct's fingerprints (column fp) that differ in total bits at most.

    Only counts of prefixes, bounded by the number of prefixes, come to the driver.
    """
    n = distinct.count()
    budgets = (total // 2, (total - 1) // 2)
    bits = min(max((max(n, 1) // USUAL_IN_NODE).bit_length(), FIRST_BITS[0]), FIRST_BITS[1])
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for trie in (0, 1):
        key = F.col("fp") if trie == 0 else F.shiftrightunsigned("fp", 32).bitwiseOR(F.shiftleft("fp", 32))
        depth, rows = bits, distinct.select(key.alias("k"))
        while True:
            counts[trie, depth] = found = _as_dict(rows.groupBy(F.shiftrightunsigned("k", 64 - depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n")))
            heavy = [p for p, c in found.items() if c > MOST_IN_UNIT // 2]
            if not heavy or depth + MORE_BITS >= 64:
                break
            rows = rows.filter(F.shiftrightunsigned("k", 64 - depth).isin(heavy))
            depth += MORE_BITS
    units = distinct.mapInArrow(_units(counts, bits, budgets, total, MOST_IN_UNIT), "trie int, depth int, lo long, hi long, side int, keys binary")
    return units.groupBy("trie", "depth", "lo", "hi").applyInPandas(_linker(budgets, total), "u long, v long")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node of edges (u, v); root is the component's smallest node.

    Large-star and small-star steps in turn, each result checkpointed, until a round changes nothing.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.unionByName(low.filter("m <> u").select("u", F.col("m").alias("v"))).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        if not now[0]:
            break
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _grouped(slim: DataFrame, key: str, total: int) -> DataFrame:
    """slim, which is stored, with ``root`` (a fingerprint that names the component) and ``component`` (its smallest key)."""
    distinct = stored(slim.groupBy("fp").agg(F.min(F.col(f"`{key}`")).alias("first")), "simhash-distinct")
    roots = components(near_links(distinct.select("fp"), total))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "root", "first")
    linked = stored(named.filter("root IS NOT NULL"), "simhash-linked")
    # One component may hold most fingerprints: its smallest key comes to each of them without a task that holds them all.
    least = stored(linked.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component")), "simhash-least")
    of = dealt_join(linked, least, F.col("root") == F.col("of"), F.col("fp")).select("fp", "root", "component")
    of = of.unionByName(named.filter("root IS NULL").select("fp", F.col("fp").alias("root"), F.col("first").alias("component")))
    of = stored(of.withColumnRenamed("fp", "__fp__"), "simhash-components")
    return dealt_join(slim, of, F.col("fp") == F.col("__fp__"), F.col(f"`{key}`")).drop("__fp__")


def simhash_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", total: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, component): each row's fingerprint, and the smallest key of its component.

    A null text has no words and, as every text without words, fingerprint 0. Equal texts have equal
    fingerprints and are linked; rows with one key and different texts are linked by their texts only. A null
    key is never the smallest unless all are null. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    slim = stored(with_fingerprint(rows, "text", shingle, ("key",)), "simhash")
    return _grouped(slim, "key", total).select(F.col("key").alias(key), "fp", "component")


def hex_fingerprint(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", total: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """docs' rows, one of each component: one with the smallest key (null last), as docs' columns.

    Of rows that share key and text but not the rest, the one with the least hash of all columns stays, and of rows that are
    equal in all columns, one; so a rerun keeps the same. Null and blank texts are one component. An empty table gives an empty one;
    column names may be anything.
    """
    own, least = F.col(f"`{key}`"), row_hash(docs)
    other = F.xxhash64(F.lit(1), least, own.cast("string"), F.col(f"`{text}`"))
    order = F.struct(own.isNull().alias("none"), own.alias("key"), least.alias("h"), other.alias("g"))
    slim = stored(with_fingerprint(docs.select(order.alias("id"), F.col(f"`{text}`").alias("text")), "text", shingle, ("id",)), "simhash")
    rows = _grouped(slim, "id", total).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("component").alias("component"))
    h, g, drop_h, drop_g = (fresh(docs, name) for name in ("__row__", "__other__", "__drop_row__", "__drop_other__"))
    # The rows to drop, and the few kept ones that occur more than once, are found by their hashes.
    marked = stored(rows.filter("n > 1 OR id <> component").select(F.col("id.h").alias(drop_h), F.col("id.g").alias(drop_g), (F.col("id") == F.col("component")).alias("again")), "simhash-drop")
    hashed = docs.withColumns({h: least, g: other})
    same = (F.col(h) == F.col(drop_h)) & (F.col(g) == F.col(drop_g))
    names = [F.col(f"`{c}`") for c in docs.columns]

    def met(drop: DataFrame) -> DataFrame:
        small = maybe_broadcast(drop, *MARKED)
        return drop.hint("merge") if small is drop else small  # else Spark's own bound would broadcast what is over this one

    once = hashed.join(met(marked.select(drop_h, drop_g)), same, "left_anti")
    again = hashed.join(met(marked.filter("again").select(drop_h, drop_g)), same, "left_semi").dropDuplicates([h, g])
    return once.unionByName(again).select(*names)
