"""Measures and steps of one page image, a grey array: sharpness, noise, contrast, skew, blocks; deskewing, contrast, binarising.

Small helpers in numpy for ``operators.images``, which applies them to rasters in Arrow batches.
"""

from __future__ import annotations

import numpy as np

# At what a measure counts as full, or as none.
SHARP, NOISE_FREE, NOISE_SPAN, CONTRAST, SKEW_MOST, BLOCKY, DPI = 200.0, 5.0, 25.0, 180.0, 8.0, 40.0, 250.0
SKEW_TRUSTED, EDGE_LEAST, EDGE, TURN_LEAST = 15.0, 200, 150.0, 0.15


def _padded(g: np.ndarray, by: int, mode: str = "reflect") -> np.ndarray:
    return np.pad(g.astype(np.float64), by, mode if min(g.shape) > by else "edge")


def laplacian(g: np.ndarray) -> np.ndarray:
    p = _padded(g, 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def gaussian(g: np.ndarray, size: int, mode: str = "reflect") -> np.ndarray:
    """Blurred by a window of ``size`` pixels whose width follows from it."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    p = _padded(g, size // 2, mode)
    rows = sum(w * p[i : i + g.shape[0]] for i, w in enumerate(k))
    return sum(w * rows[:, i : i + g.shape[1]] for i, w in enumerate(k))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (x, y), in order around it."""
    p = np.unique(points, axis=0)

    def chain(rows):
        out: list = []
        for a in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (a[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (a[0] - out[-2][0]):
                out.pop()
            out.append(a)
        return out[:-1]

    return np.array(chain(p.tolist()) + chain(p[::-1].tolist()) if len(p) > 2 else p.tolist(), np.float64)


def skew(g: np.ndarray) -> float:
    """Degrees by which the smallest rectangle around all edges is turned; 0 for few edges and for more than SKEW_TRUSTED."""
    s = _padded(gaussian(g, 3), 1)
    dx = (s[:-2, 2:] + 2 * s[1:-1, 2:] + s[2:, 2:]) - (s[:-2, :-2] + 2 * s[1:-1, :-2] + s[2:, :-2])
    dy = (s[2:, :-2] + 2 * s[2:, 1:-1] + s[2:, 2:]) - (s[:-2, :-2] + 2 * s[:-2, 1:-1] + s[:-2, 2:])
    y, x = np.nonzero(np.abs(dx) + np.abs(dy) > EDGE)
    if len(y) < EDGE_LEAST:
        return 0.0
    corners = hull(np.stack([x, y], axis=1))
    sides = np.roll(corners, -1, axis=0) - corners
    best, turned = np.inf, 0.0
    for a in np.unique(np.mod(np.arctan2(sides[:, 1], sides[:, 0]), np.pi / 2)).tolist():
        c, s_ = np.cos(a), np.sin(a)
        u, v = corners @ np.array([c, s_]), corners @ np.array([-s_, c])
        size = np.ptp(u) * np.ptp(v)
        if size < best - 1e-9:
            best, turned = size, np.degrees(a)
    turned = turned - 90 if turned > 45 else turned
    return float(turned) if abs(turned) <= SKEW_TRUSTED else 0.0


def blockiness(g: np.ndarray, block: int = 8) -> float | None:
    """Mean difference of opposite sides of blocks of the image at a quarter of its size; None for one smaller than a block."""
    h, w = max(8, g.shape[0] // 4), max(8, g.shape[1] // 4)
    y, x = (np.arange(n + 1) * m // n for n, m in ((h, g.shape[0]), (w, g.shape[1])))
    if min(g.shape) < block:
        return None
    area = np.diff(y)[:, None] * np.diff(x)[None]
    small = np.add.reduceat(np.add.reduceat(g.astype(np.float64), y[:-1], axis=0), x[:-1], axis=1) / np.maximum(area, 1)
    y, x = np.arange(0, h - block, block), np.arange(0, w - block, block)
    if not len(y) or not len(x):
        return 0.0
    tiles = small[y[:, None, None, None] + np.arange(block)[:, None], x[None, :, None, None] + np.arange(block)]
    return float((np.abs(tiles[..., 0] - tiles[..., -1]).mean() + np.abs(tiles[..., 0, :] - tiles[..., -1, :]).mean()) / 2)


def measures(g: np.ndarray, dpi: float) -> dict[str, float]:
    """resolution, blur, noise, contrast, skew, compression (each 0 to 1, higher is better) and skew_deg."""
    unit = lambda v: float(min(1.0, max(0.0, v)))
    low, high = np.percentile(g, [5, 95])
    turned, blocks = skew(g), blockiness(g)
    return {
        "resolution": unit(dpi / DPI if dpi else min(g.shape) / 1500), "blur": unit(laplacian(g).var() / SHARP), "noise": unit(1 - ((g - gaussian(g, 5)).std() - NOISE_FREE) / NOISE_SPAN),
        "contrast": unit((high - low) / CONTRAST), "skew": unit(1 - abs(turned) / SKEW_MOST), "compression": 0.7 if blocks is None else unit(1 - blocks / BLOCKY), "skew_deg": turned,
    }


def turned(g: np.ndarray, degrees: float) -> np.ndarray:
    """Turned around its middle by interpolation; what comes in at the border repeats it."""
    if abs(degrees) < TURN_LEAST:
        return g
    h, w = g.shape
    a, (cy, cx) = np.radians(degrees), (h / 2, w / 2)
    y, x = np.mgrid[:h, :w]
    sx = np.clip(np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx, 0, w - 1)
    sy = np.clip(np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy, 0, h - 1)
    x0, y0 = np.minimum(sx.astype(int), w - 2 if w > 1 else 0), np.minimum(sy.astype(int), h - 2 if h > 1 else 0)
    fx, fy = sx - x0, sy - y0
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    out = (g[y0, x0] * (1 - fx) + g[y0, x1] * fx) * (1 - fy) + (g[y1, x0] * (1 - fx) + g[y1, x1] * fx) * fy
    return np.rint(out).astype(np.uint8)


def equalized(g: np.ndarray, limit: float, tiles: int = 8) -> np.ndarray:
    """Contrast by the brightness of each tile, no value more than ``limit`` times as frequent as the mean, blended between tiles."""
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), "symmetric" if min(g.shape) >= max(th * tiles - h, tw * tiles - w) else "edge")
    cells = p.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, -1)
    counts = np.stack([np.bincount(c, minlength=256) for c in cells])
    most = max(1, int(limit * th * tw / 256))
    over = np.maximum(counts - most, 0).sum(1)
    counts = np.minimum(counts, most) + over[:, None] // 256
    maps = np.clip(np.rint(np.cumsum(counts, axis=1) * (255 / (th * tw))), 0, 255).reshape(tiles, tiles, 256)
    ty, tx = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(ty).astype(int), np.floor(tx).astype(int)
    fy, fx = (ty - y0)[:, None], (tx - x0)[None]
    at = lambda y, x: maps[np.clip(y, 0, tiles - 1)[:, None], np.clip(x, 0, tiles - 1)[None], g]
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.rint(out).astype(np.uint8)


def smoothed(g: np.ndarray, strength: float) -> np.ndarray:
    """Each pixel as the mean of those around it whose own surroundings look alike; ``strength``: how unlike they may be."""
    total, weights = np.zeros(g.shape), np.zeros(g.shape)
    p = _padded(g, 5)
    size = lambda a: sum(a[i : i + a.shape[0] - 2, j : j + a.shape[1] - 2] for i in range(3) for j in range(3)) / 9
    near = p[4:-4, 4:-4]
    for dy in range(-3, 4):
        for dx in range(-3, 4):
            moved = p[4 + dy : p.shape[0] - 4 + dy, 4 + dx : p.shape[1] - 4 + dx]
            weight = np.exp(-size((near - moved) ** 2) / strength**2)
            total += weight * moved[1:-1, 1:-1]
            weights += weight
    return np.rint(total / weights).astype(np.uint8)


def binarized(g: np.ndarray, size: int = 35, by: float = 10) -> np.ndarray:
    """White where not darker than the surroundings by ``by``."""
    return np.where(g > np.rint(gaussian(g, size, "edge")) - by, 255, 0).astype(np.uint8)


#: Steps by the names of ``quality.STEPS``; rendering is done and bands are cut from what comes out.
STEPS = {
    "deskew": lambda g, m: turned(g, m["skew_deg"]), "mild_denoise": lambda g, m: smoothed(g, 10.0), "denoise": lambda g, m: smoothed(g, 20.0),
    "contrast_normalization": lambda g, m: equalized(g, 2.0), "contrast_enhancement": lambda g, m: equalized(g, 3.0), "binarize": lambda g, m: binarized(g),
}
