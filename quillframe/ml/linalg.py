"""Dense linear algebra on the driver, for matrices that models leave there; tall tables go through their Gram matrix first."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from quillframe.errors import DataValidationError, ShapeError
from quillframe.ml.linear import gram


def _square(a) -> np.ndarray:
    a = np.asarray(a, float)
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ShapeError("a square matrix is needed")
    return a


def svd(a, full_matrices: bool = True):
    return np.linalg.svd(np.asarray(a, float), full_matrices=full_matrices)


def qr(a, mode: str = "reduced"):
    return np.linalg.qr(np.asarray(a, float), mode)


def lu(a):
    """P, L, U with a = P L U, by partial pivoting."""
    u = np.array(a, float)
    n, m = u.shape
    order, low = np.arange(n), np.eye(n, min(n, m))
    for k in range(min(n, m)):
        pivot = k + int(np.abs(u[k:, k]).argmax())
        if u[pivot, k] == 0:
            continue
        if pivot != k:
            u[[k, pivot]], order[[k, pivot]] = u[[pivot, k]], order[[pivot, k]]
            low[[k, pivot], :k] = low[[pivot, k], :k]
        if k < low.shape[1]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return np.eye(n)[:, order], low, np.triu(u[: min(n, m)])


def cholesky(a):
    a = _square(a)
    if not np.allclose(a, a.T, atol=1e-10):
        raise DataValidationError("the matrix is not symmetric")
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError as e:
        raise DataValidationError("the matrix is not positive definite") from e


def eig(a):
    """Values and vectors; complex ones are an error."""
    a = _square(a)
    if np.allclose(a, a.T):
        return np.linalg.eigh(a)
    values, vectors = np.linalg.eig(a)
    if np.abs(values.imag).max(initial=0) > 1e-10:
        raise DataValidationError("the eigenvalues are complex")
    return values.real, vectors.real


def eigh(a):
    return np.linalg.eigh(_square(a))


def eigvals(a):
    return eig(a)[0]


def eigvalsh(a):
    return eigh(a)[0]


def solve(a, b):
    try:
        return np.linalg.solve(_square(a), np.asarray(b, float))
    except np.linalg.LinAlgError as e:
        raise DataValidationError("the matrix is singular") from e


def solve_triangular(a, b, lower: bool = True):
    a, b = _square(a), np.array(b, float)
    x = np.zeros_like(b)
    for i in range(len(a)) if lower else reversed(range(len(a))):
        if a[i, i] == 0:
            raise DataValidationError("the matrix is singular")
        x[i] = (b[i] - a[i] @ x) / a[i, i]
    return x


def lstsq(a, b):
    return np.linalg.lstsq(np.asarray(a, float), np.asarray(b, float), rcond=None)


def inv(a):
    return solve(a, np.eye(len(a)))


def pinv(a, rcond: float | None = None):
    a = np.asarray(a, float)
    return np.linalg.pinv(a, rcond if rcond is not None else np.finfo(float).eps * max(a.shape))


def norm(a, order=None):
    return float(np.linalg.norm(np.asarray(a, float), order))


def cond(a, order=2):
    if order not in (2, "fro"):
        raise DataValidationError("order 2 or fro")
    return float(np.linalg.cond(np.asarray(a, float), order))


def det(a):
    return float(np.linalg.det(_square(a)))


def slogdet(a):
    return tuple(map(float, np.linalg.slogdet(_square(a))))


def trace(a, offset: int = 0):
    return float(np.trace(np.asarray(a, float), offset))


def matrix_rank(a, tol: float | None = None):
    return int(np.linalg.matrix_rank(np.asarray(a, float), tol))


def table_svd(df: DataFrame, columns: Sequence[str]):
    """Singular values and right vectors of a tall table: the eigenvectors of its Gram matrix, made by one aggregation."""
    n, mean, c = gram(df, columns)
    values, vectors = np.linalg.eigh(c + n * np.outer(mean, mean))
    order = np.argsort(values)[::-1]
    return np.sqrt(np.clip(values[order], 0, None)), vectors[:, order].T
