"""Hamiltonian sampling: the no-U-turn sampler with dual averaging, and the normal mixture's log density and gradient.

Independent of a panel's tables: functions of arrays, for use inside grouped tasks (a chain is a group).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

Density = Callable[[np.ndarray], tuple[float, np.ndarray]]
#: An energy error beyond this is a divergence (a fixed value of the method).
DIVERGENCE = 1000.0


class _Tree:
    """What a trajectory's half holds: its ends, its proposal, how many states fit the slice, whether to go on, acceptance."""

    __slots__ = ("minus", "plus", "proposal", "n", "going", "accept", "tried", "diverged")

    def __init__(self, minus, plus, proposal, n, going, accept, tried, diverged):
        self.minus, self.plus, self.proposal, self.n, self.going, self.accept, self.tried, self.diverged = minus, plus, proposal, n, going, accept, tried, diverged


class NoUTurn:
    """A chain over `density` (log density and its gradient), the mass matrix fitted in the first parts of the warm-up, the step in all of it."""

    def __init__(self, density: Density, start: np.ndarray, seed: int, target: float = 0.8, depth: int = 8):
        self.density, self.rng, self.target, self.depth = density, np.random.RandomState(seed), target, depth
        self.state = (np.asarray(start, float), *density(np.asarray(start, float)))
        self._take_masses(np.eye(len(start)))
        self.step = self._first_step()

    def _take_masses(self, inverse: np.ndarray) -> None:
        """Momenta have the inverse of this covariance, so that trajectories see round level sets."""
        self.inverse, self.root = inverse, np.linalg.inv(np.linalg.cholesky(inverse)).T

    def _momentum(self) -> np.ndarray:
        return self.root @ self.rng.normal(size=len(self.root))

    def _leap(self, q: np.ndarray, grad: np.ndarray, p: np.ndarray, step: float) -> tuple:
        p = p + 0.5 * step * grad
        q = q + step * (self.inverse @ p)
        value, grad = self.density(q)
        return q, value, grad, p + 0.5 * step * grad

    def _joint(self, value: float, p: np.ndarray) -> float:
        with np.errstate(over="ignore", invalid="ignore"):
            joint = value - 0.5 * float(p @ self.inverse @ p)
        return joint if math.isfinite(joint) else -math.inf

    def _first_step(self) -> float:
        """A step whose acceptance crosses one half."""
        step, (q, value, grad) = 1.0, self.state
        p = self._momentum()
        error = lambda s: self._joint(*(lambda x: (x[1], x[3]))(self._leap(q, grad, p, s))) - self._joint(value, p)
        up = error(step) > math.log(0.5)
        for _ in range(50):
            if (error(step) > math.log(0.5)) != up:
                break
            step *= 2.0 if up else 0.5
        return step

    def _build(self, edge: tuple, slice_: float, direction: int, depth: int, joint0: float) -> _Tree:
        q, value, grad, p = edge
        if depth == 0:
            new = self._leap(q, grad, p, direction * self.step)
            joint = self._joint(new[1], new[3])
            return _Tree(new, new, new, int(slice_ <= joint), slice_ < joint + DIVERGENCE, min(1.0, math.exp(min(0.0, joint - joint0))), 1, slice_ >= joint + DIVERGENCE)
        first = self._build(edge, slice_, direction, depth - 1, joint0)
        if not first.going:
            return first
        second = self._build(first.minus if direction < 0 else first.plus, slice_, direction, depth - 1, joint0)
        return self._joined(first, second, direction, second.n / max(first.n + second.n, 1))

    def _joined(self, a: _Tree, b: _Tree, direction: int, odds: float) -> _Tree:
        minus, plus = (b.minus, a.plus) if direction < 0 else (a.minus, b.plus)
        span = plus[0] - minus[0]
        straight = span @ minus[3] >= 0 and span @ plus[3] >= 0
        proposal = b.proposal if self.rng.rand() < odds else a.proposal
        return _Tree(minus, plus, proposal, a.n + b.n, b.going and straight, a.accept + b.accept, a.tried + b.tried, a.diverged or b.diverged)

    def advance(self) -> tuple[float, bool]:
        """One draw: (mean acceptance, whether the trajectory diverged)."""
        q, value, grad = self.state
        p = self._momentum()
        joint = self._joint(value, p)
        slice_ = joint + math.log(max(self.rng.rand(), 1e-300))
        here = (q, value, grad, p)
        tree = _Tree(here, here, here, 1, True, 0.0, 0, False)
        for depth in range(self.depth):
            direction = 1 if self.rng.rand() < 0.5 else -1
            new = self._build(tree.minus if direction < 0 else tree.plus, slice_, direction, depth, joint)
            odds = min(1.0, new.n / max(tree.n, 1)) if new.going else 0.0
            tree = self._joined(tree, new, direction, odds)
            if not tree.going:
                break
        self.state = tree.proposal[:3]
        return tree.accept / max(tree.tried, 1), tree.diverged

    def _tune(self, rounds: int) -> list[np.ndarray]:
        """Dual averaging of the log step towards the target acceptance; the draws on the way."""
        centre, error, mean, kept = math.log(10 * self.step), 0.0, 0.0, []
        for i in range(1, rounds + 1):
            accept, _ = self.advance()
            kept.append(self.state[0])
            error += (self.target - accept - error) / (i + 10)
            log_step = centre - math.sqrt(i) / 0.05 * error
            mean += i**-0.75 * (log_step - mean)
            self.step = math.exp(log_step)
        self.step = math.exp(mean)
        return kept

    def run(self, warm_up: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
        """(draws, whether each one's trajectory diverged)."""
        for _ in range(2):
            kept = np.array(self._tune(warm_up // 3)[warm_up // 6 :])
            n = len(kept)
            if n > 10:
                self._take_masses(np.cov(kept.T).reshape(kept.shape[1], -1) * n / (n + 5) + 5e-3 / (n + 5) * np.eye(kept.shape[1]))
                self.step = self._first_step()
        self._tune(warm_up - 2 * (warm_up // 3))
        out, diverged = [], []
        for _ in range(draws):
            diverged.append(self.advance()[1])
            out.append(self.state[0])
        return np.array(out), np.array(diverged)


def mixture_density(x: np.ndarray, k: int) -> Density:
    """Log density of a mixture of k normals with the priors of kernels.gibbs_mixture: uniform weights, normal means of twice
    the data's deviation, inverse-gamma variances. Coordinates: k - 1 logits, the first mean, logs of the k - 1 gaps between
    ascending means, k logs of deviations."""
    n, scale = len(x), float(x.std()) + 1e-12

    def density(z: np.ndarray) -> tuple[float, np.ndarray]:
        logits = np.r_[z[: k - 1], 0.0]
        with np.errstate(over="ignore", invalid="ignore"):
            gaps = np.exp(z[k : 2 * k - 1])
            means, log_sd = z[k - 1] + np.r_[0.0, np.cumsum(gaps)], z[2 * k - 1 :]
            log_w = logits - logits.max() - math.log(np.exp(logits - logits.max()).sum())
            w, precision = np.exp(log_w), np.exp(-2 * log_sd)
            e = x[:, None] - means
            logs = log_w - log_sd - 0.5 * e * e * precision
            top = logs.max(1, keepdims=True)
            r = np.exp(logs - top)
            total = r.sum(1, keepdims=True)
            value = float((top[:, 0] + np.log(total[:, 0])).sum() + log_w.sum() - (means**2).sum() / (8 * scale**2) + z[k : 2 * k - 1].sum() - (4 * log_sd + 0.5 * scale**2 * precision).sum())
        if not math.isfinite(value):
            return -math.inf, np.zeros_like(z)
        r /= total
        by_mean = (r * e * precision).sum(0) - means / (4 * scale**2)
        by_sd = (r * (e * e * precision - 1)).sum(0) - 4 + scale**2 * precision
        below = np.cumsum(by_mean[::-1])[::-1]
        return value, np.r_[(r.sum(0) - n * w + 1 - k * w)[: k - 1], below[0], gaps * below[1:] + 1, by_sd]

    return density


def mixture(x: np.ndarray, seed: int, k: int = 5, warm_up: int = 300, draws: int = 300) -> dict[str, np.ndarray]:
    """Posterior draws of weights, ascending means and deviations, and which draws diverged."""
    means = np.quantile(x, np.linspace(0.1, 0.9, k))
    start = np.r_[np.zeros(k - 1), means[0], np.log(np.maximum(np.diff(means), 1e-3 * (x.std() + 1e-12))), np.full(k, math.log(x.std() + 1e-12))]
    z, diverged = NoUTurn(mixture_density(x, k), start, seed).run(warm_up, draws)
    logits = np.column_stack([z[:, : k - 1], np.zeros(len(z))])
    w = np.exp(logits - logits.max(1, keepdims=True))
    return {"weights": w / w.sum(1, keepdims=True), "means": z[:, k - 1 : k] + np.column_stack([np.zeros(len(z)), np.cumsum(np.exp(z[:, k : 2 * k - 1]), axis=1)]), "sds": np.exp(z[:, 2 * k - 1 :]), "diverged": diverged}
