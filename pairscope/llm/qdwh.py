"""Eigenvectors of a symmetric matrix by spectral divide and conquer with QDWH polar decompositions.

The polar factor U of A - s I has eigenvalue 1 where an eigenvalue of A lies above s and -1 where it lies below, so (I + U) / 2
projects on the upper invariant subspace. Bases of both subspaces split A into two smaller matrices, and so on down to single
eigenvalues. Work is cubic in the dimension and memory square; nothing here depends on how many vectors there are.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix, by dynamically weighted Halley steps (at most a dozen)."""
    d = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(d)
    x, low = a / norm, _EPS
    for _ in range(30):
        before = x
        step = (4 * (1 - low**2) / low**4) ** (1 / 3)
        root = np.sqrt(1 + step)
        p = root + np.sqrt(8 - 4 * step + 8 * (2 - low**2) / (low**2 * root)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            # far from orthogonal: the QR form stays accurate
            both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(d)]))
            x = q / r * x + (p - q / r) / np.sqrt(r) * both[:d] @ both[d:].T
        else:
            x = q / r * x + (p - q / r) * np.linalg.solve(np.eye(d) + r * x.T @ x, x.T).T
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        if 1 - low < 10 * _EPS and np.linalg.norm(x - before) < _EPS ** (1 / 3):
            break
    return x


def _shifts(a: np.ndarray) -> list[float]:
    """Values inside the spectrum to split at; the mean of the diagonal always has eigenvalues on both sides."""
    diagonal = np.sort(np.diag(a))
    mean, spread = diagonal.mean(), np.linalg.norm(a - diagonal.mean() * np.eye(len(a))) / np.sqrt(len(a))
    return [float(np.median(diagonal)), float(mean), *[float(mean + spread * f) for f in (0.01, -0.013, 0.1, -0.17, 0.37, -0.41)]]


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k vectors span the upper invariant subspace, and k."""
    d = len(a)
    start = np.random.default_rng(d).standard_normal((d, d))
    best = None
    for shift in _shifts(a):
        upper = (polar_factor(a - shift * np.eye(d)) + np.eye(d)) / 2
        k = int(round(np.trace(upper)))
        if not 0 < k < d:
            continue
        basis = start
        for _ in range(3):
            basis, _ = np.linalg.qr(np.hstack([upper @ basis[:, :k], basis[:, k:] - upper @ basis[:, k:]]))
        # an eigenvalue too near the shift leaves no clean projector, and so a rest between the blocks
        rest = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or rest < best[0]:
            best = rest, basis, k
        if rest <= 8 * d * _EPS * scale:
            break
    return best and best[1:]


def _solve(a: np.ndarray, wanted: int, scale: float) -> np.ndarray:
    """Columns: unit eigenvectors of at least the ``wanted`` largest eigenvalues, upper subspaces first."""
    d = len(a)
    if d == 1 or np.linalg.norm(a - np.diag(a).mean() * np.eye(d)) <= d * _EPS * scale:
        return np.eye(d)
    split = _split(a, scale)
    if split is None:
        return np.eye(d)
    basis, k = split
    blocks = basis[:, :k], basis[:, k:]
    out = []
    for block, need in zip(blocks, (wanted, wanted - k)):
        if need > 0:
            inner = block.T @ a @ block
            out.append(block @ _solve((inner + inner.T) / 2, need, scale))
    return np.hstack(out)


def leading_components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (all, if there are fewer), falling, and their unit eigenvectors as columns.

    A vector's largest entry is positive. Eigenvalues that equal each other to rounding get any orthogonal vectors.
    """
    scale = float(np.linalg.norm(a))
    vectors = _solve(a, wanted, scale) if scale else np.eye(len(a))
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(len(order))] < 0, -1.0, 1.0)
