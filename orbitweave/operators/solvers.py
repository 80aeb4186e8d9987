"""Small dense algebra and optimisers on the driver, sized by knobs and never by readings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

Vector = np.ndarray


@dataclass
class Adam:
    """Adam steps; ``decay`` adds a multiple of the values to the gradient."""

    rate: float = 1e-3
    first: float = 0.9
    second: float = 0.999
    epsilon: float = 1e-8
    decay: float = 0.0
    mean: Vector | None = None
    square: Vector | None = None
    count: int = 0

    def step(self, values: Vector, gradient: Vector, rate: float | None = None) -> Vector:
        g = gradient + self.decay * values
        if self.mean is None:
            self.mean, self.square = np.zeros_like(g), np.zeros_like(g)
        self.count += 1
        self.mean = self.first * self.mean + (1 - self.first) * g
        self.square = self.second * self.square + (1 - self.second) * g * g
        m = self.mean / (1 - self.first**self.count)
        v = self.square / (1 - self.second**self.count)
        return values - (self.rate if rate is None else rate) * m / (np.sqrt(v) + self.epsilon)


@dataclass
class LimitedMemory:
    """L-BFGS without line search: clipped gradients and steps, damped pairs, a smoothed first scale."""

    memory: int = 10
    clip: float = 1.0
    damping: float = 0.2
    pairs: list[tuple[Vector, Vector]] = field(default_factory=list)
    last: tuple[Vector, Vector] | None = None
    scale: float = 1.0

    def step(self, values: Vector, gradient: Vector, rate: float = 1.0) -> Vector:
        g = gradient * min(1.0, self.clip / max(np.linalg.norm(gradient), 1e-300))
        if self.last is not None:
            self._remember(values - self.last[0], g - self.last[1])
        self.last = (values.copy(), g.copy())
        q, weights = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            weights.append(a)
        q *= self.scale
        for (s, y), a in zip(self.pairs, reversed(weights), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        move = -rate * q
        return values + move * min(1.0, self.clip / max(np.linalg.norm(move), 1e-300))

    def _remember(self, s: Vector, y: Vector) -> None:
        ss, sy = s @ s, s @ y
        if ss == 0:
            return
        curved = ss / self.scale
        if sy < self.damping * curved:
            mix = (1 - self.damping) * curved / (curved - sy)
            y = mix * y + (1 - mix) * s / self.scale
        self.pairs = [*self.pairs, (s, y)][-self.memory :]
        ratio = min(10.0, max(0.1, ss / (s @ y) / self.scale))
        self.scale *= 0.8 + 0.2 * ratio


@dataclass(frozen=True)
class Evaluation:
    """Loss, gradient and Hessian at a point."""

    loss: float
    gradient: Vector
    hessian: Vector


@dataclass(frozen=True)
class Outcome:
    """The best point, its loss, why the search ended, and the accepted losses."""

    values: Vector
    loss: float
    reason: str
    losses: tuple[float, ...]


def levenberg_marquardt(
    evaluate: Callable[[Vector], Evaluation | None],
    start: Vector,
    trial: Callable[[Vector], float] | None = None,
    damping: float = 1e-3,
    raise_by: float = 10.0,
    lower_by: float = 10.0,
    most_damping: float = 1e12,
    steps: int = 50,
    gradient_limit: float = 1e-12,
    loss_limit: float = 1e-12,
    on_accept: Callable[[int, Vector, float], None] = lambda *_: None,
) -> Outcome:
    """Damped Gauss-Newton from ``start``; a step counts only if it lowers the loss.

    ``trial`` gives a loss alone and cheaper; a full evaluation follows only an
    improvement. A rejected step is tried again from the best point with more damping.
    An evaluation of None means that the model failed there.
    """
    best = evaluate(start)
    values = np.array(start, dtype=float)
    if best is None:
        return Outcome(values, float("nan"), "failed", ())
    losses = [best.loss]
    for step in range(steps):
        if np.abs(best.gradient).max(initial=0.0) <= gradient_limit:
            return Outcome(values, best.loss, "gradient_converged", tuple(losses))
        while True:
            point = values + damped_step(best.hessian, best.gradient, damping)
            if np.array_equal(point, values):
                return Outcome(values, best.loss, "no_progress", tuple(losses))
            cheap = trial(point) if trial else None
            found = evaluate(point) if cheap is None or cheap < best.loss else None
            if found is not None and found.loss < best.loss:
                break
            damping *= raise_by
            if damping > most_damping:
                return Outcome(values, best.loss, "damping_exhausted", tuple(losses))
        change = (best.loss - found.loss) / max(abs(best.loss), 1e-300)
        values, best, damping = point, found, max(damping / lower_by, 1e-15)
        losses.append(best.loss)
        on_accept(step, values, best.loss)
        if change <= loss_limit:
            return Outcome(values, best.loss, "loss_converged", tuple(losses))
    return Outcome(values, best.loss, "steps_exhausted", tuple(losses))


def damped_step(hessian: Vector, gradient: Vector, damping: float) -> Vector:
    """The solution of (H + damping diag H) d = -g, by least squares where it is singular."""
    system = hessian + damping * np.diag(np.diag(hessian))
    try:
        return np.linalg.solve(system, -gradient)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(system, -gradient, rcond=None)[0]


def add_prior(evaluation: Evaluation, alphas: Vector, values: Vector, centre: Vector | None = None) -> Evaluation:
    """The evaluation with half the sum of alpha times the squared distance from ``centre``."""
    delta = values - (0 if centre is None else centre)
    return Evaluation(
        evaluation.loss + 0.5 * float(alphas @ (delta * delta)), evaluation.gradient + alphas * delta, evaluation.hessian + np.diag(alphas)
    )


def family_alphas(diagonal: Vector, families: Sequence[str], strengths: Mapping[str, float]) -> Vector:
    """Per knob: its family's strength times the median of the family's positive diagonal; families must match."""
    if set(families) != set(strengths):
        raise ValueError(f"prior and knobs differ in {sorted(set(families) ^ set(strengths))}")
    names = np.array(families)
    medians = {f: diagonal[(names == f) & (diagonal > 0)] for f in strengths}
    return np.array([strengths[f] * (float(np.median(medians[f])) if len(medians[f]) else 0.0) for f in families])


@dataclass(frozen=True)
class Reduced:
    """A system of knobs after its diagonal gains were eliminated."""

    hessian: Vector
    gradient: Vector
    gains: Callable[[Vector], Vector]


def eliminate_gains(uu: Vector, ub: Vector, bb: Vector, gu: Vector, gb: Vector, ridge: float) -> Reduced:
    """Schur complement over gains with a diagonal block: exact, as gains touch only their own monitor."""
    inverse = 1.0 / (bb + ridge)
    hessian = uu - (ub * inverse) @ ub.T
    gradient = gu - ub @ (inverse * gb)
    return Reduced(hessian, gradient, lambda step: -inverse * (gb + ub.T @ step))


def covariance(normal: Vector, floor: float = 1e-35) -> Vector:
    """Inverse of a symmetric matrix with eigenvalues no smaller than ``floor``."""
    values, vectors = np.linalg.eigh(normal)
    return (vectors / np.maximum(values, floor)) @ vectors.T


def sandwich(normal: Vector, noise: Vector) -> Vector:
    """Covariance of the estimate when readings are shared: inverse normal, noise, inverse normal."""
    inverse = covariance(normal)
    return inverse @ noise @ inverse


@dataclass(frozen=True)
class Degeneracy:
    """Rank, condition number, eigenvalues relative to the largest, and weak directions by knob."""

    rank: int
    condition: float
    relative: Vector
    insensitive: tuple[str, ...]
    directions: tuple[tuple[float, tuple[tuple[str, float], ...]], ...]


def degeneracy(normal: Vector, names: Sequence[str], rel_tol: float = 1e-8, zero: float = 1e-15, share: float = 0.1) -> Degeneracy:
    """Which knobs, and which combinations of them, the data cannot tell apart.

    The matrix is scaled to a unit diagonal first. A direction lists the knobs whose
    part is at least ``share`` of its largest one, the largest first.
    """
    diagonal = np.diag(normal).copy()
    dead = diagonal <= zero * max(float(diagonal.max(initial=0.0)), zero)
    scale = np.where(dead, 0.0, 1 / np.sqrt(np.where(dead, 1.0, diagonal)))
    values, vectors = np.linalg.eigh(normal * np.outer(scale, scale))
    top = max(float(values.max(initial=0.0)), 1e-300)
    relative = values / top
    weak = relative < rel_tol
    directions = []
    for k in np.flatnonzero(weak):
        part = np.abs(vectors[:, k])
        order = [i for i in np.argsort(-part, kind="stable") if part[i] >= share * part.max()]
        directions.append((float(relative[k]), tuple((names[i], float(vectors[i, k])) for i in order)))
    condition = float("inf") if weak.any() else float(top / values.min())
    return Degeneracy(int((~weak).sum()), condition, relative, tuple(n for n, d in zip(names, dead, strict=True) if d), tuple(directions))


def constrained_least(covariances: Vector, names: Sequence[str], n: int = 10) -> list[tuple[str, float]]:
    """The ``n`` knobs with the largest standard deviation."""
    sigma = np.sqrt(np.maximum(np.diag(covariances), 0))
    return [(names[i], float(sigma[i])) for i in np.argsort(-sigma, kind="stable")[:n]]


def expand(saved: Mapping[str, float], knobs: Sequence[str]) -> Vector:
    """A saved vector in the order of ``knobs``, 0 where it has none; a saved knob that is not there is an error."""
    if missing := set(saved) - set(knobs):
        raise ValueError(f"unknown knobs {sorted(missing)}")
    return np.array([float(saved.get(k, 0.0)) for k in knobs])
