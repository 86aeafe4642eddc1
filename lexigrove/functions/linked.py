"""Connected components of small graphs in arrays, whole groups of sorted batches, and the steps around them that Spark has no expression for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Union-find over arrays: for each of ``n`` nodes the smallest node that edges (x, y) connect it with.

    Each round hangs the larger root of every edge under the smaller one and then shortens all paths to their roots, so long
    chains halve with each round.
    """
    root = np.arange(n)
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return root
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def touching(line: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of strokes (sorted by line, begin; disjoint within a line) in adjoining lines that share a side or a corner."""
    width = int(end.max(initial=0)) + 2
    key_begin, key_end = line * width + begin, line * width + end
    # the strokes of the next line from the first that ends at or behind this one's begin to the last that begins at or before its end
    first = np.searchsorted(key_end, (line + 1) * width + begin, "left")
    last = np.searchsorted(key_begin, (line + 1) * width + end, "right")
    size = np.maximum(last - first, 0)
    total = np.cumsum(size)
    of = np.repeat(np.arange(len(line)), size)
    return of, np.repeat(first - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def whole_groups(batches):
    """Tables of whole groups from batches in which ``n`` counts the rows of a group from one, with where each group begins; as many as a batch completes."""
    held: list = []
    for b in batches:
        at = np.flatnonzero(b.column("n").to_numpy() == 1)
        if len(at):
            held.append(b.slice(0, at[-1]))
            t = pa.Table.from_batches(held)
            if len(t):
                yield t, np.flatnonzero(t.column("n").to_numpy() == 1)
            held = [b.slice(at[-1])]
        else:
            held.append(b)
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.flatnonzero(t.column("n").to_numpy() == 1)
