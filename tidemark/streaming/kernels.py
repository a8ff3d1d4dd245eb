"""State machines of the online models. Their random numbers depend on seed and step alone, so a replay gives the same results."""

from __future__ import annotations

import math

import numpy as np


def systematic(weights: np.ndarray, u: float) -> np.ndarray:
    """Indices of a systematic resampling."""
    n = len(weights)
    return np.minimum(np.searchsorted(np.cumsum(weights), (u + np.arange(n)) / n, side="right"), n - 1)


class ParticleFilter:
    """Bootstrap filter over five regimes."""

    def __init__(self, n: int = 1000, seed: int = 42, trans: np.ndarray | None = None, means: np.ndarray | None = None, sds: np.ndarray | None = None):
        self.n, self.seed, self.step = n, seed, 0
        self.trans = np.full((5, 5), 0.05) + 0.75 * np.eye(5) if trans is None else trans
        self.means, self.sds = means, sds
        self.particles = self._rng().integers(0, 5, n)
        self.weights = np.full(n, 1 / n)

    def _rng(self) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=self.seed, counter=self.step << 64))

    def update(self, x: float) -> np.ndarray:
        self.step += 1
        rng = self._rng()
        cum = np.cumsum(self.trans / self.trans.sum(1, keepdims=True), axis=1)
        self.particles = np.minimum((cum[self.particles] < rng.random(self.n)[:, None]).sum(1), 4)
        if self.means is not None:
            like = np.maximum(np.exp(-0.5 * ((x - self.means) / self.sds) ** 2) / (self.sds * math.sqrt(2 * math.pi)), 1e-12)
        else:
            like = np.exp(np.clip(np.array([10 * x, 4 * x, -10 * abs(x), 2 * x, -10 * x]), -500, 500))
        w = self.weights * like[self.particles]
        self.weights = w / w.sum() if w.sum() > 0 else np.full(self.n, 1 / self.n)
        if 1 / (self.weights**2).sum() < self.n / 2:
            self.particles = self.particles[systematic(self.weights, rng.random())]
            self.weights = np.full(self.n, 1 / self.n)
        p = np.bincount(self.particles, self.weights, 5)
        return p / p.sum()


class Changepoints:
    """Bayesian online changepoint detection with a normal-inverse-gamma model.

    The probability of run length 0 is the hazard, whatever the data; what tells a change is the mass of short runs and
    the most likely run length, which are returned too.
    """

    def __init__(self, hazard: float = 100.0, mu: float = 0.0, kappa: float = 1.0, alpha: float = 1.0, beta: float = 1e-4, most: int = 500, short: int = 5):
        self.hazard, self.prior, self.most, self.short = 1 / hazard, (mu, kappa, alpha, beta), most, short
        self.runs = np.array([1.0])
        self.mu, self.kappa, self.alpha, self.beta = (np.array([v]) for v in self.prior)

    def update(self, x: float) -> tuple[float, float, int]:
        """(P(run length 0), P(run length <= short), most likely run length)."""
        df, scale = 2 * self.alpha, np.sqrt(np.maximum(self.beta * (self.kappa + 1) / (self.alpha * self.kappa), 1e-12))
        gamma = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in df])
        pdf = np.maximum(np.exp(gamma - 0.5 * np.log(df * math.pi) - np.log(scale) - (df + 1) / 2 * np.log1p(((x - self.mu) / scale) ** 2 / df)), 1e-12)
        joint = self.runs * pdf
        r = np.r_[joint.sum() * self.hazard, joint * (1 - self.hazard)]
        r = (r / r.sum() if r.sum() > 0 else np.eye(1, len(r))[0])[: self.most]
        self.runs = r / r.sum()
        k = len(self.runs) - 1
        mu0, kappa0, alpha0, beta0 = self.mu[:k], self.kappa[:k], self.alpha[:k], self.beta[:k]
        self.beta = np.r_[self.prior[3], beta0 + 0.5 * kappa0 / (kappa0 + 1) * (x - mu0) ** 2]
        self.mu = np.r_[self.prior[0], (kappa0 * mu0 + x) / (kappa0 + 1)]
        self.kappa, self.alpha = np.r_[self.prior[1], kappa0 + 1], np.r_[self.prior[2], alpha0 + 0.5]
        return float(self.runs[0]), float(self.runs[: self.short + 1].sum()), int(np.argmax(self.runs))


class DirichletCounts:
    """Decayed counts of regimes: a streaming Dirichlet posterior."""

    def __init__(self, decay: float = 0.99, prior: float = 1.0):
        self.decay, self.counts = decay, np.full(5, prior)

    def update(self, p: np.ndarray) -> np.ndarray:
        self.counts = self.decay * self.counts + p
        return self.counts / self.counts.sum()
