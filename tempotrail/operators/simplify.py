"""Line simplification on arrays; imported by Python workers, so it needs no Spark."""

from __future__ import annotations

import math

import numpy as np

TOLERANCE_M = 4.0


def kept_indices(points: np.ndarray, tolerance_m: float = TOLERANCE_M) -> np.ndarray:
    """Ramer-Douglas-Peucker over (lat, lon) on a local plane in metres, without recursion."""
    y = np.radians(points[:, 0]) * 6_371_008.8
    x = np.radians(points[:, 1]) * 6_371_008.8 * math.cos(math.radians(float(points[:, 0].mean())))
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    open_spans = [(0, len(points) - 1)]
    while open_spans:
        a, b = open_spans.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
        length = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / length, 0, 1) if length else np.zeros(len(px))
        away = np.hypot(px - t * dx, py - t * dy)
        far = int(away.argmax())
        if away[far] > tolerance_m:
            keep[a + 1 + far] = True
            open_spans += [(a, a + 1 + far), (a + 1 + far, b)]
    return np.flatnonzero(keep)
