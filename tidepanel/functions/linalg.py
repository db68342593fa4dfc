"""Small dense linear algebra on the driver."""

from __future__ import annotations

import numpy as np

RANK_TOLERANCE = 1e-9


def ridge_if_singular(a: np.ndarray, least: float = 1e-12, extra: float = 1e-10) -> np.ndarray:
    """a, lifted on the diagonal when the least eigenvalue of its symmetric part is under ``least``."""
    low = float(np.linalg.eigvalsh((a + a.T) / 2)[0]) if len(a) else np.inf
    return a if low >= least else a + np.eye(len(a)) * (least - low + extra)


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of the lifted matrix."""
    return np.linalg.inv(ridge_if_singular(a))


def pivoted_qr(a: np.ndarray, tie: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """(|diagonal of R|, column order) of a Householder QR with column pivoting.

    Of columns whose remaining norms are equal up to ``tie`` the first is taken,
    so that rounding does not decide between exact combinations of columns.
    """
    r = np.array(a, dtype=float)
    rows, p = r.shape
    order = np.arange(p)
    diagonal = np.zeros(p)
    for k in range(min(rows, p)):
        norms = np.sqrt((r[k:, k:] ** 2).sum(axis=0))
        top = norms.max()
        ties = np.flatnonzero(norms >= top * (1 - tie))
        j = k + int(ties[np.argmin(order[k:][ties])])
        r[:, [k, j]] = r[:, [j, k]]
        order[[k, j]] = order[[j, k]]
        x = r[k:, k].copy()
        size = np.linalg.norm(x)
        diagonal[k] = size
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        r[k:, k:] -= 2 * np.outer(x, x @ r[k:, k:])
    return diagonal, order


def rank_and_columns(a: np.ndarray, tolerance: float = RANK_TOLERANCE) -> tuple[int, list[int]]:
    """(numerical rank, sorted columns that span it)."""
    if not a.size:
        return 0, []
    d, order = pivoted_qr(a)
    rank = int((d > tolerance * d.max()).sum()) if d.max() > 0 else 0
    return rank, sorted(order[:rank].tolist())


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR, which keeps all column norms and angles of the rows."""
    return rows if len(rows) <= rows.shape[1] else np.linalg.qr(rows, mode="r")
