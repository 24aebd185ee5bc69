"""Euclidean distances between all rows of two matrices, a strip at a time, in memory of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CELLS = 1 << 20  # of one strip
FEW = 8  # columns up to which differences are as fast as a product
CLOSE, SLACK = 1e-4, 1e-12  # shares of the squared lengths: below the first a product loses digits; its error is below the second


class Squares:
    """Squared distances of rows of x to rows of y, as one product of matrices.

    Rows are moved by the mean of y first; pairs that are close, measured by their lengths, are subtracted column by
    column, as a product would lose their digits. Few columns, or values that are not finite, are always subtracted.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        self.plain = x.shape[1] <= FEW or not (np.isfinite(x).all() and np.isfinite(y).all()) or not len(y)
        if not self.plain:
            middle = y.mean(axis=0)
            u, self.v = x - middle, y - middle
            self.u, self.uu, self.vv = -2 * u, (u * u).sum(axis=1), (self.v * self.v).sum(axis=1)
            self.scale = self.uu + self.vv.max()

    def exact(self, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        """Of pairs of rows, or of a row with rows, from their differences."""
        gap = self.y[j] - self.x[i]
        return (gap * gap).sum(axis=1)

    def slack(self, a: int, b: int) -> np.ndarray:
        """How far the squares of rows a to b may be off, a column."""
        return np.zeros((b - a, 1)) if self.plain else SLACK * self.scale[a:b, None]

    def block(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        """Rows a to b of x against rows c to d of y."""
        if self.plain:
            return sum(((self.x[a:b, k, None] - self.y[None, c:d, k]) ** 2 for k in range(self.x.shape[1])), np.zeros((b - a, d - c)))
        out = self.u[a:b] @ self.v[c:d].T
        out += self.uu[a:b, None]
        out += self.vv[c:d]
        at = np.flatnonzero(out < CLOSE * self.scale[a:b, None])
        for s in range(0, len(at), 1 << 14):
            i, j = np.divmod(at[s : s + (1 << 14)], d - c)
            out[i, j] = self.exact(a + i, c + j)
        return out

    def strips(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(a, b, squares of the rows a to b of x with all of y)."""
        rows = max(1, CELLS // max(1, len(self.y)))
        for a in range(0, len(self.x), rows):
            b = min(len(self.x), a + rows)
            yield a, b, self.block(a, b, 0, len(self.y))
