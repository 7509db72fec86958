"""SentencePiece models as a weighted finite-state transducer over the tropical semiring.

A model file becomes three transducers: a normaliser (a dummy prefix, white space to U+2581), one
with an arc path for each piece, and a byte fallback with an arc for each character. Their composition with a text
is a lattice whose nodes are places in the text; its shortest path is the encoding. In a unigram model an arc
weighs minus its piece's score. In a BPE model an arc weighs nothing where its piece may follow the
piece before it (the merges of both together leave just these two) and infinity elsewhere, so the one
path of finite weight is the result of the merges.

No arc enters a U+2581 from another character or crosses a character that is in no longer piece. All paths
meet there, so that the parts between are solved on their own, and a part met before is looked up.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mapped, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What an unknown character costs beyond the worst piece of a unigram model.
UNKNOWN_COST = 10.0
#: New parts, or pairs, after which a worker forgets those before the last so many.
REMEMBERED = 250_000
INFINITY = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """A model file's pieces and rules, compiled."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.byte_fallback, self.unknown = UNIGRAM, False, 0
        self.dummy_prefix, self.squeeze, self.escape = True, True, True
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif field == 2:
                own = dict(_fields(value))
                self.kind, self.byte_fallback, self.unknown = own.get(3, UNIGRAM), bool(own.get(35, 0)), own.get(40, 0)
            elif field == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("models with a character map aren't supported")
                self.dummy_prefix, self.squeeze, self.escape = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self._compile()

    def _compile(self) -> None:
        self.ids = {p: k for k, p in enumerate(self.pieces) if self.types[k] in (NORMAL, USER_DEFINED)}
        usable = [s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL]
        self.best, self.worst = max(usable, default=0.0), min(usable, default=0.0)
        self.byte_ids = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.types[k] == BYTE}
        #: The piece transducer: a state is [piece that ends there or -1, arcs by character].
        self.start: list = [-1, {}]
        for piece, k in self.ids.items():
            state = self.start
            for c in piece:
                state = state[1].setdefault(c, [-1, {}])
            state[0] = k
        self.costs = {p: -self.scores[k] for p, k in self.ids.items()}
        #: Two characters that no piece has next to each other: no arc crosses the place between them.
        self.together = {a + b for p in self.ids for a, b in itertools.pairwise(p)}
        longer = set(itertools.chain.from_iterable(p for p in self.ids if len(p) > 1))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            self.parts = re.compile(r"(?s).+")
        else:
            inner = "".join(re.escape(c) for c in sorted(longer - {SPACE}))
            self.parts = re.compile(rf"(?s){SPACE}*[{inner}]+|{SPACE}+|." if inner else r"(?s).")
        self.remembered: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, float] = {}
        self.output = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]

    # --- the three transducers -------------------------------------------------------------------------

    def normalised(self, text: str) -> str:
        """The normaliser's output for text."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def arcs(self, part: str, at: int) -> Iterator[tuple[int, float]]:
        """(end, weight) of the arcs that leave ``at``: of pieces, and of the fallback if the character is no piece."""
        state, known = self.start, False
        for end in range(at, len(part)):
            state = state[1].get(part[end])
            if state is None:
                break
            k = state[0]
            if k >= 0:
                known |= end == at
                yield end + 1, -(self.scores[k] if self.types[k] == NORMAL else (end + 1 - at) * self.best - 0.1)
        if not known:
            yield at + 1, UNKNOWN_COST - self.worst

    def fallback(self, piece: str) -> tuple[int, ...]:
        """What the byte fallback writes for a character that is no piece."""
        return tuple(self.byte_ids[b] for b in piece.encode()) if self.byte_fallback else (self.unknown,)

    # --- shortest paths ----------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """What is left of text's characters after all merges, best score first, then from the left."""
        if len(text) <= 24:
            return self._merged_short(list(text))
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbols) and (both := symbols[i] + symbols[j]) in self.ids:
                heapq.heappush(heap, (-self.scores[self.ids[both]], i, j, both))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, None
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in symbols if s is not None]

    def _merged_short(self, symbols: list[str]) -> list[str]:
        """As ``merged``, by looking through all neighbours for each merge."""
        cost = self.costs.get
        while len(symbols) > 1:
            both = [a + b for a, b in itertools.pairwise(symbols)]
            of = [cost(x, INFINITY) for x in both]
            least = min(of)
            if least == INFINITY:
                break
            i = of.index(least)
            symbols[i : i + 2] = [both[i]]
        return symbols

    def _follows(self, a: int, b: int) -> float:
        """Weight of piece b after piece a in a BPE model; after no piece (-1), whether b's own merges make it."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        after = [self.pieces[a]] if a >= 0 else []
        whole = [*after, self.pieces[b]]
        found = self.pairs[a * len(self.pieces) + b] = 0.0 if self.merged("".join(whole)) == whole else INFINITY
        return found

    def _merge_path(self, part: str) -> list[str] | None:
        """The path of finite weight in a BPE model, or None where a character of part is no piece or none is found.

        Finite paths weigh nothing, so the first one that reaches the end is the shortest. Long arcs come first;
        nodes (a place and the piece before it) without a way on are left for good.
        """
        n, size, pairs, start = len(part), len(self.pieces), self.pairs, self.start
        at, before, open_arcs, trail, dead = 0, -1, None, [], set()
        while at < n:
            if open_arcs is None:
                open_arcs, state = [], start
                for end in range(at, n):
                    state = state[1].get(part[end])
                    if state is None:
                        break
                    if state[0] >= 0:
                        open_arcs.append((end + 1, state[0]))
                if not open_arcs or open_arcs[0][0] != at + 1:
                    return None
            while open_arcs:
                arc = open_arcs.pop()
                weight = pairs.get(before * size + arc[1])
                if weight is None:
                    weight = self._follows(before, arc[1])
                if not weight and arc not in dead:
                    trail.append((at, before, open_arcs))
                    (at, before), open_arcs = arc, None
                    break
            else:
                if not trail:
                    return None
                dead.add((at, before))
                at, before, open_arcs = trail.pop()
        places = [t[0] for t in trail] + [n]
        return [part[a:b] for a, b in itertools.pairwise(places)]

    def path(self, part: str) -> list[str]:
        """The pieces, or characters that are none, on the shortest path through part's lattice."""
        if self.kind == BPE:
            # Characters that are no piece, and equal scores, can make merges depend on more than two
            # pieces: only then are the merges carried out.
            return self._merge_path(part) or self.merged(part)
        n = len(part)
        cost, back = [INFINITY] * (n + 1), [-1] * (n + 1)
        cost[0] = 0.0
        for at in range(n):
            for end, weight in self.arcs(part, at):
                if cost[at] + weight < cost[end]:
                    cost[end], back[end] = cost[at] + weight, at
        out, end = [], n
        while end:
            out.append(part[back[end] : end])
            end = back[end]
        return out[::-1]

    def _uncut(self, part: str) -> bytes:
        """Ids of a part that has no place which all paths meet, as far as pairs of characters tell."""
        ids = itertools.chain.from_iterable((self.ids[p],) if p in self.ids else itertools.chain.from_iterable(map(self.fallback, p)) for p in self.path(part))
        return array("i", ids).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a part. What hasn't been met among the last REMEMBERED new parts is forgotten."""
        found = self.remembered.get(part) or self.older.get(part)
        if not found:
            cuts = [k for k, pair in enumerate(map("".join, itertools.pairwise(part)), 1) if pair not in self.together]
            found = b"".join(self._part(part[a:b]) for a, b in itertools.pairwise([0, *cuts, len(part)])) if cuts else self._uncut(part)
        if len(part) <= 64:
            if len(self.remembered) >= REMEMBERED:
                self.remembered, self.older = {}, self.remembered
            self.remembered[part] = found
        return found

    def encoded(self, text: str) -> bytes:
        """Token ids of text as 32-bit numbers."""
        parts = self.parts.findall(self.normalised(text))
        found = list(map(self.remembered.get, parts))
        if None in found:
            found = [self._part(p) if x is None else x for p, x in zip(parts, found, strict=True)]
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encoded(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        out = b"".join(map(self.output.__getitem__, ids))
        if self.dummy_prefix and out.startswith(b" "):
            out = out[1:]
        return out.decode("utf-8", "replace")


_models: dict[str, Model] = {}


def load(path: str) -> Model:
    """The compiled model of a file, once for each process."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Model(f.read())
    return _models[path]


def encoded(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", check: str | None = None) -> DataFrame:
    """docs' columns ``keep``, the token ids of each whole text (null: no ids), and in ``check``, if
    named, whether decoding the ids gives the normalised text's words back, byte for byte.

    A U+2581 in a text is a space to the model and is decoded as one. Rows keep their number.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        model = load(model_path)
        for batch in slices(batches, len(keep), 2 << 20):
            texts = ["" if t is None else t for t in batch.column(len(keep)).to_pylist()]
            found = [model.encoded(t) for t in texts]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)])
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))]
            if check:
                columns.append(pa.array([model.decode(array("i", x).tolist()) == _plain(model, t) for x, t in zip(found, texts, strict=True)], pa.bool_()))
            yield columns

    return mapped(docs, keep, text, each, [(ids, T.ArrayType(T.IntegerType())), *[(check, "boolean")] * bool(check)])


def _plain(model: Model, text: str) -> str:
    out = model.normalised(text).replace(SPACE, " ")
    return out[1:] if model.dummy_prefix and out.startswith(" ") else out


def decoded(tokens: DataFrame, model_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """tokens' columns ``keep`` and the text of their ids; null ids give null."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        model = load(model_path)
        for batch in batches:
            out = [None if x is None else model.decode(x) for x in batch.column(len(keep)).to_pylist()]
            yield [*batch.columns[:-1], pa.array(out, pa.string())]

    return mapped(tokens, keep, ids, each, [(text, "string")])
