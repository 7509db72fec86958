"""Faces: greedy matching of two sets, and suppression of overlapping boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import fold_groups

ACCEPT, OVERLAP = 0.45, 0.4


def match_faces(a: np.ndarray, b: np.ndarray, accept: float = ACCEPT) -> float:
    """Share of matched faces among all: each of a, in order, takes the best free one of b if their cosine is above accept. 1 for two empty sets, 0 for one."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    cosine = np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 1e-12)
    free, matched = np.ones(len(b), dtype=bool), 0
    for row in cosine:
        row = np.where(free, row, -np.inf)
        k = int(row.argmax())
        if row[k] > accept:
            free[k] = False
            matched += 1
    return matched / (len(a) + len(b) - matched)


def face_overlap_pairs(pairs: DataFrame, a: str, b: str, out: str = "overlap", accept: float = ACCEPT) -> DataFrame:
    """pairs with the overlap of the face sets (arrays of vectors) a and b in place of them."""
    kept = [c for c in pairs.columns if c not in (a, b)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value = [match_faces(*(np.array([np.asarray(f, dtype=np.float64) for f in (s if s is not None else [])]) for s in x), accept=accept) for x in zip(batch[a], batch[b], strict=True)]
            yield batch[kept].assign(**{out: value})

    return pairs.mapInPandas(run, pairs.select(*kept).schema.add(out, "double"))


def box_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union of boxes (x1, y1, x2, y2)."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def suppressed(boxes: DataFrame, image: str = "image", overlap: float = OVERLAP) -> DataFrame:
    """The boxes (image, x1, y1, x2, y2, score) that no kept box with a higher score overlaps by more than overlap."""

    names = [image, "x1", "y1", "x2", "y2", "score", *[c for c in boxes.columns if c not in (image, "x1", "y1", "x2", "y2", "score")]]

    def keep(_: object, rows: Iterator[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for row in sorted(rows, key=lambda r: (-r[5], *r[1:5])):
            if all(box_overlap(row[1:5], other[1:5]) <= overlap for other in kept):
                kept.append(row)
        return kept

    rows = boxes.select(*names)
    return fold_groups(rows, image, keep, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


def main_face(faces: str) -> F.Column:
    """The face (struct with x1, y1, x2, y2) of the largest area; the last of equals."""
    return F.array_max(F.transform(F.col(faces), lambda f, k: F.struct(((f["x2"] - f["x1"]) * (f["y2"] - f["y1"])).alias("area"), k.alias("k"), f.alias("face"))))["face"]
