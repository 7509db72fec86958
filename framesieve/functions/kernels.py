"""Kernels on one picture at a time, in NumPy: planes are float64 arrays of rows, pictures uint8 arrays of rows, columns and RGB."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Sides to which analysis scales a picture down.
ANALYSIS_SIDE, SIGNAL_SIDE, NOISE_SIDE, COLOR_SIDE = 2048, 768, 384, 384


def luma(rgb: np.ndarray) -> np.ndarray:
    """Whole-number luma of RGB."""
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.uint8)


# --- scaling -------------------------------------------------------------------------------------------------


@lru_cache(256)
def _lanczos_taps(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, fixed-point weights) of Lanczos-3, each n_out x taps; weights have 22 bits after the point."""
    scale = n_in / n_out
    spread = max(scale, 1.0)
    support = 3.0 * spread
    centre = (np.arange(n_out) + 0.5) * scale
    low = np.maximum((centre - support + 0.5).astype(int), 0)
    high = np.minimum((centre + support + 0.5).astype(int), n_in)
    places = low[:, None] + np.arange((high - low).max())
    x = (places - centre[:, None] + 0.5) / spread
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0) * (places < high[:, None])
    w /= w.sum(1, keepdims=True)
    fixed = np.where(w < 0, np.ceil(w * (1 << 22) - 0.5), np.floor(w * (1 << 22) + 0.5)).astype(np.int64)
    return np.minimum(places, n_in - 1), fixed


def lanczos(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """uint8 pixels scaled horizontally, then vertically, clipped to bytes after each."""

    def along(p: np.ndarray, n: int) -> np.ndarray:
        if p.shape[0] == n:
            return p
        places, weights = _lanczos_taps(p.shape[0], n)
        out = np.full((n, *p.shape[1:]), 1 << 21, dtype=np.int64)
        for k in range(places.shape[1]):
            out += p[places[:, k]].astype(np.int64) * weights[:, k].reshape(-1, *[1] * (p.ndim - 1))
        return np.clip(out >> 22, 0, 255).astype(np.uint8)

    return along(along(pixels.swapaxes(0, 1), width).swapaxes(0, 1), height)


def fitted(width: int, height: int, side_x: int, side_y: int) -> tuple[int, int]:
    """The size, of the same shape, that fits the box; what rounds to the nearest shape."""
    if width <= side_x and height <= side_y:
        return width, height
    aspect = width / height

    def nearest(x: float, key) -> int:  # noqa: ANN001
        return max(min(math.floor(x), math.ceil(x), key=key), 1)

    if side_x / side_y >= aspect:
        return nearest(side_y * aspect, lambda n: abs(aspect - n / side_y)), side_y
    return side_x, nearest(side_x / aspect, lambda n: 0 if n == 0 else abs(aspect - side_x / n))


def thumbnail(pixels: np.ndarray, side: int) -> np.ndarray:
    """pixels within side x side: whole blocks are averaged down to about twice the size first."""
    h, w = pixels.shape[:2]
    width, height = fitted(w, h, side, side)
    if (width, height) == (w, h):
        return pixels
    fx, fy = max(int(w / width / 2), 1), max(int(h / height / 2), 1)
    if (fx > 1 or fy > 1) and w >= fx and h >= fy:
        cut = pixels[: h // fy * fy, : w // fx * fx].astype(np.int64)
        block = cut.reshape(h // fy, fy, w // fx, fx, *pixels.shape[2:]).sum((1, 3))
        pixels = ((block + fx * fy // 2) // (fx * fy)).astype(np.uint8)
    return lanczos(pixels, width, height)


def bilinear(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Linear in both directions, from pixel centres; beyond the first centres it goes on in a line."""

    def along(p: np.ndarray, n: int) -> np.ndarray:
        at = (np.arange(n) + 0.5) * (p.shape[0] / n) - 0.5
        low = np.maximum(np.floor(at), 0).astype(int)
        part = (at - low)[:, None]
        return p[low] * (1 - part) + p[np.minimum(low + 1, p.shape[0] - 1)] * part

    return plane.astype(np.float64) if plane.shape == (height, width) else along(along(plane.astype(np.float64), height).T, width).T


def _reflected(plane: np.ndarray, radius: int) -> np.ndarray:
    return np.pad(plane, radius, mode="reflect")


def box3(plane: np.ndarray) -> np.ndarray:
    p, (h, w) = _reflected(plane, 1), plane.shape
    return sum(p[y : y + h, x : x + w] for y in range(3) for x in range(3)) / 9.0


def gaussian(plane: np.ndarray, taps: int = 9, sigma: float = 2.5) -> np.ndarray:
    r = taps // 2
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    p, (h, w) = _reflected(plane, r), plane.shape
    rows = sum(k[i] * p[:, i : i + w] for i in range(taps))
    return sum(k[i] * rows[i : i + h] for i in range(taps))


# --- hashes --------------------------------------------------------------------------------------------------


def to_hex(bits: np.ndarray) -> str:
    return np.packbits(bits.astype(bool).reshape(-1)).tobytes().hex()


def average_hash(plane: np.ndarray) -> str:
    return to_hex(plane > plane.mean())


def difference_hash(plane: np.ndarray) -> str:
    """Of a plane with one column more than rows."""
    return to_hex(plane[:, 1:].astype(int) > plane[:, :-1].astype(int))


def perceptual_hash(plane: np.ndarray, n: int = 8) -> str:
    """Of a 4n x 4n plane: the lowest n x n cosine terms against their median."""
    size = plane.shape[0]
    k = np.arange(size)
    basis = 2 * np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * size))
    low = (basis @ plane.astype(np.float64) @ basis.T)[:n, :n]
    return to_hex(low > np.median(low))


def wavelet_hash(plane: np.ndarray, n: int = 8) -> str:
    """Of a plane whose side is n times a power of two: means of blocks, less the whole mean, against their median."""
    p = plane.astype(np.float64) / 255.0
    p = p - p.mean()
    while p.shape[0] > n:
        p = p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3))
    return to_hex(p > np.median(p))


def hashes(gray: np.ndarray) -> dict[str, str]:
    """The four hashes of a luma picture."""
    short = min(gray.shape)
    scale = max(8, 1 << (short.bit_length() - 1))
    return {"phash": perceptual_hash(lanczos(gray, 32, 32)), "dhash": difference_hash(lanczos(gray, 9, 8)), "whash": wavelet_hash(lanczos(gray, scale, scale)), "ahash": average_hash(lanczos(gray, 8, 8))}


# --- signals -------------------------------------------------------------------------------------------------


def laplacian(plane: np.ndarray) -> np.ndarray:
    """Of the inner pixels."""
    return 4 * plane[1:-1, 1:-1] - plane[:-2, 1:-1] - plane[2:, 1:-1] - plane[1:-1, :-2] - plane[1:-1, 2:]


def laplacian_variance(plane: np.ndarray) -> float:
    return float(laplacian(plane).var()) if min(plane.shape) >= 3 else 0.0


def centre(plane: np.ndarray, share: float = 0.6) -> np.ndarray:
    h, w = plane.shape
    ch, cw = max(int(h * share), 1), max(int(w * share), 1)
    return plane[(h - ch) // 2 : (h - ch) // 2 + ch, (w - cw) // 2 : (w - cw) // 2 + cw]


def tenengrad(plane: np.ndarray) -> float:
    if min(plane.shape) < 3:
        return 0.0
    gx, gy = plane[1:-1, 2:] - plane[1:-1, :-2], plane[2:, 1:-1] - plane[:-2, 1:-1]
    return float((gx * gx + gy * gy).mean())


def spectrum(plane: np.ndarray) -> tuple[float, float]:
    """(share of high frequencies, anisotropy of middle ones) of the centre square under a Hann window."""
    side = min(plane.shape)
    if side < 16:
        return 0.0, 0.0
    y, x = (plane.shape[0] - side) // 2, (plane.shape[1] - side) // 2
    square = plane[y : y + side, x : x + side]
    if side > 256:
        square, side = bilinear(square, 256, 256), 256
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(side) / (side - 1))
    size = np.abs(np.fft.fft2((square - square.mean()) * window[:, None] * window))
    size = np.roll(size, (-(side // 2), -(side // 2)), (0, 1))
    size[side // 2, side // 2] = 0.0
    away = np.arange(side) - side / 2
    radius = np.hypot(away[:, None], away[None, :])
    total = size.sum() + 1e-8
    high = size[radius > 0.30 * side / 2].sum() / total
    band = (radius > 0.10 * side / 2) & (radius < 0.50 * side / 2)
    if band.sum() < 50:
        return float(high), 0.0
    angle = np.arctan2(np.broadcast_to(away[:, None], radius.shape), np.broadcast_to(away[None, :], radius.shape))[band]
    angle = np.where(angle < 0, angle + np.pi, angle)
    sector = np.minimum((angle / np.pi * 12).astype(int), 11)
    means = np.bincount(sector, weights=size[band], minlength=12) / (np.bincount(sector, minlength=12) + 1e-6)
    return float(high), float((means.max() - means.min()) / (means.max() + 1e-8))


def saliency(plane: np.ndarray) -> np.ndarray | None:
    """Spectral residual, 0 to 1; None for flat pictures."""
    if min(plane.shape) < 8:
        return None
    freq = np.fft.fft2(bilinear(plane, 64, 64))
    log = np.log(np.abs(freq) + 1e-8)
    back = np.fft.ifft2(np.exp(log - box3(log)) * np.exp(1j * np.angle(freq)))
    out = bilinear(gaussian(np.abs(back) ** 2), plane.shape[1], plane.shape[0])
    low, high = out.min(), out.max()
    if high - low < 1e-8:
        return None
    out = (out - low) / (high - low)
    return None if out.std() < 0.01 else out


def subject_sharpness(plane: np.ndarray, salient: np.ndarray) -> tuple[float | None, float | None]:
    """(variance of the subject's Laplacian, its ratio to the background's)."""
    lap, inner = laplacian(plane), salient[1:-1, 1:-1]
    subject = lap[inner >= np.quantile(salient, 0.8)]
    sharp = float(subject.var()) if min(plane.shape) >= 16 and len(subject) >= 100 else None
    if min(plane.shape) < 32:
        return sharp, None
    rest = lap[inner <= np.quantile(salient, 0.3)]
    return sharp, float(subject.var() / (rest.var() + 1e-6)) if len(subject) >= 100 and len(rest) >= 100 else None


def composition(salient: np.ndarray) -> float:
    """Half for the subject's place, three tenths for its size, a fifth for staying off the edge."""
    total = salient.sum() + 1e-8
    if total < 1e-3:
        return 0.4
    h, w = salient.shape
    cy = float((salient.sum(1) * np.arange(h)).sum() / total / max(h - 1, 1))
    cx = float((salient.sum(0) * np.arange(w)).sum() / total / max(w - 1, 1))
    points = [(a / 3, b / 3) for a in (1, 2) for b in (1, 2)] + [(0.5, 0.5)]
    place = max(0.0, 1 - min(math.hypot(cy - a, cx - b) for a, b in points) / 0.35)
    subject = salient >= np.quantile(salient, 0.8)
    share = float(subject.mean())
    size = share / 0.04 if share < 0.04 else max(0.0, 1 - (share - 0.55) / 0.45) if share > 0.55 else 1.0
    eh, ew = max(int(h * 0.05), 2), max(int(w * 0.05), 2)
    inner = subject[eh : h - eh, ew : w - ew].sum() if h > 2 * eh and w > 2 * ew else 0
    edge = float((subject.sum() - inner) / (subject.sum() + 1e-6))
    return 0.5 * place + 0.3 * size + 0.2 * (1.0 if edge < 0.25 else max(0.0, 1 - (edge - 0.25) / 0.5))


def entropy(plane: np.ndarray) -> float:
    p = np.bincount(np.clip(np.floor(plane + 0.5), 0, 255).astype(int).reshape(-1), minlength=256) / plane.size
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def worst_clipping(plane: np.ndarray) -> tuple[float, float]:
    """Largest shares, over nine cells, of pixels up to 8 and from 247."""
    h, w = plane.shape
    if min(h, w) < 9:
        return 0.0, 0.0
    cells = [plane[h * a // 3 : h * (a + 1) // 3, w * b // 3 : w * (b + 1) // 3] for a in range(3) for b in range(3)]
    return max(float((c <= 8).mean()) for c in cells), max(float((c >= 247).mean()) for c in cells)


def noise(gray: np.ndarray) -> float | None:
    """Deviation of neighbours' differences, by that of the whole."""
    if min(gray.shape) < 16:
        return None
    p = thumbnail(gray, NOISE_SIDE).astype(np.float64)
    if min(p.shape) < 8:
        return None
    return 0.0 if p.std() < 1 else float(np.abs(np.diff(p, axis=1)).std() / p.std())


def cast(rgb: np.ndarray) -> float | None:
    """Distance of the mean colour from grey."""
    h, w = rgb.shape[:2]
    if min(h, w) < 16:
        return None
    step = max(w * h // 10_000, 1)
    mean = rgb[::step, ::step].reshape(-1, 3).astype(np.float64).mean(0)
    return float(np.sqrt(((mean - mean.mean()) ** 2).sum()))


def tonal_range(plane: np.ndarray) -> float | None:
    if plane.size < 100:
        return None
    s = np.sort(plane, axis=None)
    return float(s[int((s.size - 1) * 0.95)] - s[int(s.size * 0.05)])


def signals(rgb: np.ndarray, edge_width: float | None = None, horizon: float | None = None) -> dict[str, float | None]:
    """All signals of a picture; edge width and horizon come from outside, if at all."""
    gray = luma(rgb)
    plane = thumbnail(gray, SIGNAL_SIDE).astype(np.float64)
    lap = max(laplacian_variance(plane), laplacian_variance(centre(plane)))
    high, aniso = spectrum(plane)
    parts = [min(math.log1p(lap) / math.log1p(900), 1), min(math.log1p(tenengrad(plane)) / math.log1p(2000), 1), min(high / 0.40, 1)]
    if edge_width is not None:
        parts.append(min(max((10 - edge_width) / 7, 0), 1))
    salient = saliency(plane)
    sharp, focus = subject_sharpness(plane, salient) if salient is not None else (None, None)
    dark, bright = worst_clipping(plane)
    return {
        "width": rgb.shape[1], "height": rgb.shape[0], "blur": lap, "mean": float(plane.mean()), "contrast": float(plane.std()), "over": float((plane >= 247).mean()), "under": float((plane <= 8).mean()),
        "entropy": entropy(plane), "blur_combined": sum(parts) / len(parts), "aniso": aniso, "worst_dark": dark, "worst_bright": bright, "noise": noise(gray), "cast": cast(rgb), "range": tonal_range(plane),
        "salient": sharp, "edge": edge_width, "focus": focus, "horizon": horizon, "composition": None if salient is None else composition(salient),
    }


# --- colour --------------------------------------------------------------------------------------------------


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue 0 to 180, saturation and value 0 to 1, in single precision."""
    c = rgb.astype(np.float32) / np.float32(255)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    top, low = c.max(-1), c.min(-1)
    d = top - low
    safe = np.where(d == 0, 1, d)
    hue = np.where(top == r, 60 * np.fmod((g - b) / safe, 6), np.where(top == g, 60 * ((b - r) / safe + 2), 60 * ((r - g) / safe + 4)))
    hue = np.where(d == 0, 0, np.where(hue < 0, hue + 360, hue)) / 2
    return np.stack([hue, np.where(top == 0, 0, d / np.where(top == 0, 1, top)), top], -1).astype(np.float32)


def color_histogram(rgb: np.ndarray) -> np.ndarray | None:
    """16 bins of each channel in each of nine cells, channels at sum 1, the whole at length 1; None below 16 pixels."""
    h, w = rgb.shape[:2]
    ratio = min(COLOR_SIDE / w, COLOR_SIDE / h)
    width, height = max(int(w * ratio + 0.5), 1), max(int(h * ratio + 0.5), 1)
    scaled = np.stack([bilinear(rgb[..., k].astype(np.float64), width, height) for k in range(3)], -1)
    if min(width, height) < 16:
        return None
    p = hsv(np.clip(np.floor(scaled + 0.5), 0, 255).astype(np.uint8))
    bins = np.minimum(np.floor(p * np.array([16 / 180, 16, 16], dtype=np.float32)).astype(int), 15)
    out = []
    for a in range(3):
        for b in range(3):
            cell = bins[a * height // 3 : (a + 1) * height // 3, b * width // 3 : (b + 1) * width // 3].reshape(-1, 3)
            for k in range(3):
                n = np.bincount(cell[:, k], minlength=16).astype(np.float64)
                out.append(n / max(n.sum(), 1))
    v = np.concatenate(out)
    length = np.linalg.norm(v)
    return None if length < 1e-8 else (v / length).astype(np.float32)


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """pixels as a viewer should see them, by the metadata's orientation (1 to 8)."""
    turned = {2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.swapaxes(0, 1), 6: lambda p: np.rot90(p, -1), 7: lambda p: np.rot90(p, 2).swapaxes(0, 1), 8: lambda p: np.rot90(p, 1)}
    return np.ascontiguousarray(turned.get(orientation, lambda p: p)(pixels))


def eye_openness(points: np.ndarray) -> float | None:
    """Mean ratio of height to width of both eyes of 68 landmarks; None above 0.55."""

    def ratio(e: np.ndarray) -> float:
        wide = np.linalg.norm(e[0] - e[3])
        return float((np.linalg.norm(e[1] - e[5]) + np.linalg.norm(e[2] - e[4])) / (2 * wide)) if wide > 1e-6 else 0.0

    value = (ratio(points[36:42]) + ratio(points[42:48])) / 2
    return None if value > 0.55 else value
