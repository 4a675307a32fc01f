"""Small matrices on the driver: eigenvalues, orientation, partial correlation, alignment."""

from __future__ import annotations

import numpy as np


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from large to small, none below 0, and their vectors as columns."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    order = np.argsort(-values, kind="stable")
    return np.maximum(values[order], 0), vectors[:, order]


def orient(v: np.ndarray, *others: np.ndarray) -> None:
    """Turns each column so that its largest element (the first of equals) is positive; ``others`` turn with it."""
    for k in range(v.shape[1]):
        size = np.abs(v[:, k])
        if v[np.flatnonzero(size >= size.max() * (1 - 1e-12))[0], k] < 0:
            for m in (v, *others):
                m[:, k] = -m[:, k]


def ortho_error(v: np.ndarray) -> float:
    return float(np.abs(v.T @ v - np.eye(v.shape[1])).max()) if v.size else 0.0


def elbow(values) -> int:
    """How many values stand before the largest drop, the first drop aside; 1 for fewer than three."""
    v = list(values)
    return 1 if len(v) < 3 else 1 + max(range(1, len(v) - 1), key=lambda k: v[k] - v[k + 1])


def axes_kept(rule: int, most: int, choice: int | None = None) -> int:
    if choice is not None and choice >= 2:
        return min(choice, most)
    return min(max(2, min(3, max(rule, 2))), most)


def correlation(x: np.ndarray) -> np.ndarray:
    z = x - x.mean(0)
    z = z / np.maximum(z.std(0), 1e-12)
    return z.T @ z / len(x)


def inverse(a: np.ndarray) -> np.ndarray | None:
    """Inverse of a symmetric matrix, or None near singularity."""
    values, vectors = eigen(a)
    return None if not len(values) or values[-1] < 1e-9 else (vectors / values) @ vectors.T


def partial_correlation(r: np.ndarray) -> np.ndarray | None:
    p = inverse(r)
    if p is None:
        return None
    d = np.sqrt(np.diag(p))
    out = -p / np.outer(d, d)
    np.fill_diagonal(out, 1.0)
    return out


def procrustes(c: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The rotation that brings ``c`` nearest to ``target``."""
    u, _, vt = np.linalg.svd(c.T @ target)
    return u @ vt


def kmo_bartlett(r: np.ndarray, n: int) -> dict | None:
    """Sampling adequacy and Bartlett's sphericity; None if R is singular."""
    from .laws import chi2_sf

    values, _ = eigen(r)
    if values[-1] < 1e-10:
        return None
    p, partial = len(r), partial_correlation(r)
    chi2 = -(n - 1 - (2 * p + 5) / 6) * float(np.log(values).sum())
    off = ~np.eye(p, dtype=bool)
    r2, a2 = float((r[off] ** 2).sum()), float((partial[off] ** 2).sum()) if partial is not None else 0.0
    df = p * (p - 1) // 2
    return {"chi2": chi2, "df": df, "p": chi2_sf(chi2, df), "kmo": r2 / (r2 + a2) if r2 + a2 > 0 else 0.0}


def orthonormal(a: np.ndarray) -> np.ndarray:
    q, r = np.linalg.qr(a)
    return q * np.sign(np.where(np.diag(r) == 0, 1, np.diag(r)))


def random_frame(p: int, k: int, seed: int) -> np.ndarray:
    return orthonormal(np.random.default_rng(seed).normal(size=(p, k)))


def frame_path(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The frame at share ``t`` of the geodesic from a to b."""
    u, s, vt = np.linalg.svd(a.T @ b)
    start, end = a @ u, b @ vt.T
    angle = np.arccos(np.clip(s, -1, 1))
    rest = end - start * np.cos(angle)
    norm = np.sqrt((rest**2).sum(0))
    side = np.where(norm > 1e-12, rest / np.maximum(norm, 1e-12), 0)
    return (start * np.cos(t * angle) + side * np.sin(t * angle)) @ u.T


def projected_inertia(cov: np.ndarray, frame: np.ndarray) -> float:
    return float(np.trace(frame.T @ cov @ frame) / max(np.trace(cov), 1e-300))
