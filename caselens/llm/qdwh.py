"""Eigenvectors of a symmetric matrix by polar decompositions.

Spectral divide and conquer (Nakatsukasa and Higham, "Stable and efficient
spectral divide and conquer algorithms for the symmetric eigenvalue
decomposition and the SVD", 2013): the polar factor of ``A - shift * I`` has
the eigenvalue 1 where A's is above the shift and -1 below, so half its sum
with I projects on the space of the upper eigenvalues. A is restricted to both
spaces, which are split in turn until they have one dimension. Polar factors
come from the dynamically weighted Halley iteration.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)


def _least_singular(x: np.ndarray) -> float:
    """A lower bound of the least singular value."""
    try:
        return max(EPS, min(1.0, 1 / np.linalg.norm(np.linalg.inv(x))))
    except np.linalg.LinAlgError:
        return EPS


def polar(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix other than 0."""
    n = len(a)
    x = a / np.linalg.norm(a, 1)
    low = _least_singular(x)
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        weight_a = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root))) / 2
        weight_b = (weight_a - 1) ** 2 / 4
        weight_c = weight_a + weight_b - 1
        before = x
        if weight_c > 100:  # far from unitary: by QR, which bears an ill-conditioned x
            q, _ = np.linalg.qr(np.vstack([np.sqrt(weight_c) * x, np.eye(n)]))
            x = weight_b / weight_c * x + (weight_a - weight_b / weight_c) / np.sqrt(weight_c) * (q[:n] @ q[n:].T)
        else:
            z = np.eye(n) + weight_c * (x.T @ x)
            x = weight_b / weight_c * x + (weight_a - weight_b / weight_c) * np.linalg.solve(z, x.T).T
        x = (x + x.T) / 2
        low = min(1.0, low * (weight_a + weight_b * square) / (1 + weight_c * square))
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - before) < EPS ** (1 / 3):
            break
    return x


def _spaces(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal basis: ``rank`` vectors of the projector's range, then those of its complement."""
    n = len(projector)
    parts = []
    for p, size in ((projector, rank), (np.eye(n) - projector, n - rank)):
        q = rng.standard_normal((n, size))
        for _ in range(2):
            q, _ = np.linalg.qr(p @ q)
        parts.append(q)
    return np.linalg.qr(np.hstack(parts))[0]


def _shifts(a: np.ndarray) -> list[float]:
    """Between the least and the largest eigenvalue: the median and the mean of the diagonal, and points beside the mean."""
    diagonal = np.diag(a)
    mean = float(diagonal.mean())
    spread = float(np.sqrt(max(0.0, (a * a).sum() / len(a) - mean * mean)))  # standard deviation of the eigenvalues
    return [float(np.median(diagonal)), mean] + [mean + f * spread for f in (0.1, -0.1, 0.3, -0.3, 0.03, -0.03)]


def _split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """A basis in which ``a`` falls into two blocks, and the size of the first; 0 where all eigenvalues are alike."""
    n, size = len(a), np.linalg.norm(a)
    best, found = np.inf, (np.eye(n), 0)
    for shift in _shifts(a):
        moved = a - shift * np.eye(n)
        if np.linalg.norm(moved) <= n * EPS * size:
            break
        projector = (polar(moved) + np.eye(n)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        basis = _spaces(projector, rank, rng)
        rest = np.linalg.norm((basis.T @ a @ basis)[rank:, :rank])
        if rest < best:
            best, found = rest, (basis, rank)
        if rest <= 20 * EPS * size:
            break
    return found


def eigen(a: np.ndarray, *, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)`` of a symmetric matrix, values falling, one vector per column."""
    rng = np.random.default_rng(seed)
    n = len(a)
    vectors = np.eye(n)
    spaces = [(0, n)]
    while spaces:
        low, high = spaces.pop()
        if high - low < 2:
            continue
        own = vectors[:, low:high]
        part = own.T @ a @ own
        part = (part + part.T) / 2
        basis, rank = _split(part, rng)
        if rank:
            vectors[:, low:high] = own @ basis
            spaces += [(low, low + rank), (low + rank, high)]
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]
