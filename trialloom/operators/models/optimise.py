"""Minimisers for functions of a few non-negative variance ratios."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np


def nelder_mead(
    f: Callable[[np.ndarray], float], start: Sequence[float], step: float = 0.5, rounds: int = 4000, tolerance: float = 1e-7
):
    """Simplex search over the non-negative orthant (points are reflected into it), to ``tolerance`` in every direction.

    Returns the point, its value and whether the simplex has contracted to it.
    """
    g = lambda x: f(np.abs(x))
    points = [np.array(start, dtype=float)]
    for i in range(len(start)):
        corner = points[0].copy()
        corner[i] += step
        points.append(corner)
    simplex = sorted(((g(x), x) for x in points), key=lambda fx: fx[0])
    for _ in range(rounds):
        if abs(simplex[-1][0] - simplex[0][0]) < 1e-10 * (1 + abs(simplex[0][0])) and max(
            np.abs(x - simplex[0][1]).max() for _, x in simplex
        ) < tolerance:
            return np.abs(simplex[0][1]), simplex[0][0], True
        worst = simplex[-1][1]
        centre = np.mean([x for _, x in simplex[:-1]], axis=0)
        trial = centre + (centre - worst)
        value = g(trial)
        if value < simplex[0][0]:
            further = centre + 2 * (centre - worst)
            longer = g(further)
            simplex[-1] = (longer, further) if longer < value else (value, trial)
        elif value < simplex[-2][0]:
            simplex[-1] = (value, trial)
        else:
            inner = centre + 0.5 * ((trial if value < simplex[-1][0] else worst) - centre)
            shorter = g(inner)
            if shorter < min(value, simplex[-1][0]):
                simplex[-1] = (shorter, inner)
            else:
                best = simplex[0][1]
                simplex = [simplex[0]] + [
                    (g(x), x) for x in (best + 0.5 * (x - best) for _, x in simplex[1:])
                ]
        simplex.sort(key=lambda fx: fx[0])
    return np.abs(simplex[0][1]), simplex[0][0], False


def batched_quadratic(
    f: Callable[[list[np.ndarray]], list[float]],
    start: Sequence[float],
    radius: float,
    smallest: float = 2e-3,
    tolerance: float = 1e-6,
    rounds: int = 60,
) -> tuple[np.ndarray, float, bool]:
    """Trust-region search over the non-negative orthant that asks for a whole batch of values at a time.

    Each round takes a star of points around the centre; made for functions where a batch costs about as much as one
    value. If the best point lies on the star's edge the star moves there and grows; only when it lies inside is a
    quadratic fitted, its minimum taken as the next centre, and the star shrunk. Ends when the star is smaller than
    ``smallest`` of the centre and the last interior step gained less than ``tolerance``. Returns the best point, its
    value and whether it ended so; ``rounds`` guards against a function without a minimum.
    """
    centre = best = np.array(start, dtype=float)
    value = np.inf
    k = len(best)
    known: dict[tuple, float] = {}
    for _ in range(rounds):
        star = [centre]
        for i in range(k):
            for s in (-1.0, 1.0):
                p = centre.copy()
                p[i] = max(0.0, p[i] + s * radius)
                star.append(p)
        for i, j in combinations(range(k), 2):
            p = centre.copy()
            p[i] += radius
            p[j] += radius
            star.append(p)
        new = [p for p in {tuple(p): p for p in star}.values() if tuple(p) not in known]
        known.update(zip([tuple(p) for p in new], f(new)))
        before = value
        value, best = min((known[tuple(p)], tuple(p)) for p in [*star, best] if tuple(p) in known)
        best = np.array(best)
        if np.abs(best - centre).max() > 0.5 * radius:
            centre, radius = best, 2 * radius
            continue
        if radius < smallest * (1.0 + np.abs(best).max()) and before - value < tolerance * (1.0 + abs(value)):
            return best, value, True
        near = [(v, np.array(p)) for p, v in known.items() if np.abs(np.array(p) - best).max() <= 2.01 * radius]
        features = np.array([_quadratic_row(p - best) for _, p in near])
        fit = np.linalg.lstsq(features, np.array([v for v, _ in near]), rcond=None)[0]
        jump = _quadratic_step(fit, best, radius / 2)
        centre = best if jump is None else jump
        radius /= 3.0
    return best, value, False


def _quadratic_row(d: np.ndarray) -> list[float]:
    return [1.0, *d, *(d[i] * d[j] for i in range(len(d)) for j in range(i, len(d)))]


def _quadratic_step(fit: np.ndarray, best: np.ndarray, radius: float) -> np.ndarray | None:
    k = len(best)
    gradient, flat = fit[1 : 1 + k], fit[1 + k :]
    hessian = np.zeros((k, k))
    at = 0
    for i in range(k):
        for j in range(i, k):
            hessian[i, j] += flat[at]
            hessian[j, i] += flat[at]
            at += 1
    values, vectors = np.linalg.eigh(hessian)
    step = -vectors @ ((vectors.T @ gradient) / np.maximum(values, 1e-3 * max(abs(values).max(), 1e-12)))
    step = np.clip(step, -2 * radius, 2 * radius)
    point = np.maximum(best + step, 0.0)
    return None if np.abs(point - best).max() < 1e-9 else point
