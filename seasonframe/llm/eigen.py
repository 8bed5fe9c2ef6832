"""Symmetric eigenvectors by mixed precision: a float32 solve, corrected by matrix products in double and longdouble.

The correction is the iteration of Ogita and Aishima: from approximate eigenvectors X of A it takes
R = I - X'X and S = X'AX, and from them a matrix E with X(I + E) accurate to the square of X's error. It divides
by differences of eigenvalues, so eigenvalues that stand too close together are handled as one cluster: the
iteration finds the subspace of the cluster, and a smaller solve inside it, shifted and scaled to the cluster's own
spread, finds the directions. Eigenvalues that are equal to the working precision may have any directions.
"""

from __future__ import annotations

import numpy as np

HIGH = np.longdouble

# Corrections in each precision at most. The iteration squares the error, so two in double precision and two in
# longdouble do for well separated eigenvalues; more are needed where a cluster is split late.
ROUNDS = 10

# How often a cluster inside a cluster inside a cluster is solved on its own.
DEPTH = 6


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One correction: (eigenvectors, eigenvalues, the distance within which eigenvalues count as one cluster)."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    value = np.diag(s) / (1 - np.diag(r))
    apart = s - np.diag(value)
    near = 2 * (np.sqrt((apart * apart).sum()) + np.abs(value).max() * np.sqrt((r * r).sum()))
    gap = value[None, :] - value[:, None]
    far = np.abs(gap) > near
    e = np.where(far, (s + value[None, :] * r) / np.where(far, gap, 1), r / 2)
    return x + x @ e, value, near


def _clusters(value: np.ndarray, near: HIGH) -> list[np.ndarray]:
    """Places of eigenvalues in runs whose neighbours are within `near`."""
    order = np.argsort(value)[::-1]
    cut = np.flatnonzero(value[order][:-1] - value[order][1:] > near) + 1
    return np.split(order, cut)


def _refined(a: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """Eigenvectors of a (norm about one) from approximate ones, until corrections stop to shrink."""
    floor = len(a) * np.finfo(a.dtype).eps
    split: dict[tuple[int, ...], int] = {}
    before = np.inf
    for _ in range(ROUNDS):
        new, value, near = _corrected(a, x)
        moved = np.abs(new - x).max()
        x = new
        solved = False
        for places in _clusters(value, near):
            key = tuple(sorted(places.tolist()))
            if depth and len(places) > 1 and split.get(key, 0) < 4 and moved < 1e-3:
                split[key] = split.get(key, 0) + 1
                x[:, places] = _inside(a, x[:, places], depth, floor)
                solved = True
        if not solved and (moved <= floor or moved > before / 4):
            break
        before = np.inf if solved else moved
    return x


def _inside(a: np.ndarray, basis: np.ndarray, depth: int, floor: float) -> np.ndarray:
    """The basis of a cluster's subspace turned to the directions of a's own eigenvectors in it."""
    basis = _orthonormal(basis)
    middle = (basis * (a @ basis)).sum() / basis.shape[1]
    small = basis.T @ (a @ basis - middle * basis)
    small = (small + small.T) / 2
    # A cluster no wider than the rounding of `a` itself has no directions of its own.
    if np.abs(small).max() <= floor:
        return basis
    _, turn = symmetric_eigen(small, depth - 1)
    return basis @ turn.astype(basis.dtype)


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """The nearest orthonormal columns, by one Newton step from nearly orthonormal ones."""
    return x + x @ (np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2


def symmetric_eigen(a: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns), both in longdouble, of a symmetric matrix."""
    a = np.asarray(a, dtype=HIGH)
    scale = np.abs(a).max(initial=HIGH(0))
    if not scale > 0:
        return np.zeros(len(a), dtype=HIGH), np.eye(len(a), dtype=HIGH)
    a = a / scale
    _, start = np.linalg.eigh(a.astype(np.float32))
    double = _refined(a.astype(np.float64), start.astype(np.float64), depth)
    x = _orthonormal(_refined(a, double.astype(HIGH), depth))
    value = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    return value[order] * scale, x[:, order]
