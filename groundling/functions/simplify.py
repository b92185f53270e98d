"""Douglas-Peucker line simplification of many lines at once."""

from __future__ import annotations

import numpy as np


def kept_vertices(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the vertices without which a line would move by more than ``tolerance``; ends stay.

    ``offsets`` bounds the lines. All open stretches of all lines are looked at in one sweep, then those with a vertex too far off
    are cut there, so the sweeps are as many as the deepest line has levels.
    """
    keep = np.zeros(len(x), dtype=bool)
    some = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][some], offsets[1:][some] - 1
    keep[first] = keep[last] = True
    while True:
        open_ = last - first > 1
        first, last = first[open_], last[open_]
        if not len(first):
            return keep
        size = last - first - 1
        stretch = np.repeat(np.arange(len(first)), size)
        start = np.cumsum(size) - size
        at = np.arange(len(stretch)) - start[stretch] + first[stretch] + 1
        a, b = first[stretch], last[stretch]
        dx, dy, ox, oy = x[b] - x[a], y[b] - y[a], x[at] - x[a], y[at] - y[a]
        length = np.hypot(dx, dy)
        off = np.where(length == 0, np.hypot(ox, oy), np.abs(dx * oy - dy * ox) / np.where(length == 0, 1, length))
        most = np.maximum.reduceat(off, start)
        far = np.flatnonzero((off == most[stretch]) & (off > tolerance))
        far = far[np.unique(stretch[far], return_index=True)[1]]  # the first of the farthest
        cut, own = at[far], stretch[far]
        keep[cut] = True
        first, last = np.concatenate([first[own], cut]), np.concatenate([cut, last[own]])
