"""Geometry of faces and matched points, in NumPy."""

from __future__ import annotations

import numpy as np

#: Where five landmarks (eyes, nose, mouth corners) of a face belong in a 112 x 112 crop: fixed values.
ALIGNED = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])
STRIDES, ANCHORS, LEAST_SCORE = (8, 16, 32), 2, 0.5
#: Largest distance of matched descriptors, least matches, pixels that an inlier may be off.
DESCRIPTOR_BITS, LEAST_MATCHES, INLIER_PIXELS = 60, 8, 4.0


def detector_boxes(scores: np.ndarray, distances: np.ndarray, stride: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(boxes, scores) of one detector level: distances from each anchor to the four sides, in strides, clipped to the picture."""
    side = size // stride
    cell = np.arange(side * side * ANCHORS) // ANCHORS
    x, y = (cell % side) * stride, (cell // side) * stride
    keep = scores.reshape(-1)[: len(cell)] >= LEAST_SCORE
    d = distances.reshape(-1, 4)[: len(cell)][keep] * stride
    x, y = x[keep], y[keep]
    return np.clip(np.stack([x - d[:, 0], y - d[:, 1], x + d[:, 2], y + d[:, 3]], 1), 0, size), scores.reshape(-1)[: len(cell)][keep]


def similarity_transform(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 2 x 3 matrix of rotation, scale and shift that takes source nearest to target by least squares."""
    a, b = source.mean(0), target.mean(0)
    p, q = source - a, target - b
    u, s, vt = np.linalg.svd(q.T @ p / len(p))
    flip = np.array([1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    rotation = u @ np.diag(flip) @ vt
    scale = (s * flip).sum() / max((p * p).sum() / len(p), 1e-12)
    return np.hstack([scale * rotation, (b - scale * rotation @ a)[:, None]])


def inverted(affine: np.ndarray) -> np.ndarray:
    back = np.linalg.inv(affine[:, :2])
    return np.hstack([back, -back @ affine[:, 2:]])


def moved(affine: np.ndarray, points: np.ndarray) -> np.ndarray:
    return points @ affine[:, :2].T + affine[:, 2]


def warped(pixels: np.ndarray, affine: np.ndarray, width: int, height: int) -> np.ndarray:
    """pixels under affine, linear between pixels, black outside."""
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    at = moved(inverted(affine), np.stack([x.ravel(), y.ravel()], 1).astype(float))
    low = np.floor(at).astype(int)
    part = (at - low)[:, :, None]
    framed = np.pad(pixels.astype(float).reshape(*pixels.shape[:2], -1), ((1, 1), (1, 1), (0, 0)))

    def pick(dx: int, dy: int) -> np.ndarray:
        return framed[np.clip(low[:, 1] + dy + 1, 0, framed.shape[0] - 1), np.clip(low[:, 0] + dx + 1, 0, framed.shape[1] - 1)]

    top = pick(0, 0) * (1 - part[:, 0]) + pick(1, 0) * part[:, 0]
    bottom = pick(0, 1) * (1 - part[:, 0]) + pick(1, 1) * part[:, 0]
    out = top * (1 - part[:, 1]) + bottom * part[:, 1]
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8).reshape(height, width, *pixels.shape[2:])


def aligned_face(rgb: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    return warped(rgb, similarity_transform(landmarks, ALIGNED), 112, 112)


def mutual_matches(a: np.ndarray, b: np.ndarray, most: int = DESCRIPTOR_BITS) -> np.ndarray:
    """Pairs (i, j) of binary descriptors (rows of uint8) that are each other's nearest and differ in fewer than ``most`` bits."""
    if not len(a) or not len(b):
        return np.zeros((0, 2), dtype=int)
    bits = np.stack([np.bitwise_count(row ^ b).sum(1, dtype=int) for row in a])
    there, back = bits.argmin(1), bits.argmin(0)
    i = np.flatnonzero((back[there] == np.arange(len(a))) & (bits.min(1) < most))
    return np.stack([i, there[i]], 1)


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 matrix that takes points a to b by least squares; None if the points don't fix one."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(0)
        k = np.sqrt(2) / max(np.linalg.norm(p - c, axis=1).mean(), 1e-9)
        return (p - c) * k, np.array([[k, 0, -k * c[0]], [0, k, -k * c[1]], [0, 0, 1]])

    (p, s), (q, t) = scaled(a), scaled(b)
    one, zero = np.ones(len(p)), np.zeros((len(p), 3))
    base = np.column_stack([p, one])
    rows = np.vstack([np.hstack([base, zero, -q[:, :1] * base]), np.hstack([zero, base, -q[:, 1:] * base])])
    _, size, vt = np.linalg.svd(rows, full_matrices=True)
    if len(size) > 7 and size[7] < 1e-9:
        return None
    h = np.linalg.inv(t) @ vt[-1].reshape(3, 3) @ s
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def inlier_count(a: np.ndarray, b: np.ndarray, rounds: int = 500, seed: int = 0) -> int:
    """Matched points that the best homography of four takes within four pixels; 0 below eight matches. The draws are fixed by the seed."""
    if len(a) < LEAST_MATCHES:
        return 0
    rng, best = np.random.default_rng(seed), 0
    for _ in range(rounds):
        own = rng.choice(len(a), 4, replace=False)
        h = homography(a[own], b[own])
        if h is None:
            continue
        p = np.column_stack([a, np.ones(len(a))]) @ h.T
        with np.errstate(all="ignore"):
            off = np.linalg.norm(p[:, :2] / p[:, 2:] - b, axis=1)
        best = max(best, int((off <= INLIER_PIXELS).sum()))
    return best


def tensor(rgb: np.ndarray, mean: tuple[float, ...], std: tuple[float, ...], scale: float = 255.0) -> np.ndarray:
    """Channels first, one picture, normalised: what a model's input needs."""
    x = (rgb.astype(np.float32) / scale - np.array(mean, dtype=np.float32)) / np.array(std, dtype=np.float32)
    return np.ascontiguousarray(x.transpose(2, 0, 1)[None])


def centre_crop(rgb: np.ndarray, side: int) -> np.ndarray:
    h, w = rgb.shape[:2]
    y, x = (h - side) // 2, (w - side) // 2
    return rgb[y : y + side, x : x + side]
