"""Numpy kernels of the latent-state models. Nothing here needs a session."""

from __future__ import annotations

import math

import numpy as np

LOG_TINY = math.log(1e-300)


def gaussian_log(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, jitter: float = 0.0) -> np.ndarray:
    """Log density of rows under a normal distribution; a matrix that isn't positive is replaced by its diagonal."""
    d = x.shape[1]
    try:
        chol = np.linalg.cholesky(cov + jitter * np.eye(d))
        z = np.linalg.solve(chol, (x - mean).T)
        return -0.5 * (d * math.log(2 * math.pi) + 2 * np.log(np.diag(chol)).sum() + (z**2).sum(0))
    except np.linalg.LinAlgError:
        var = np.diag(cov) + 1e-6
        return -0.5 * (np.log(2 * math.pi * var) + (x - mean) ** 2 / var).sum(1)


def forward_plain(log_b: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """forward() one step after the other."""
    n, k = log_b.shape
    filtered, predicted, total = np.zeros((n, k)), np.zeros((n, k)), 0.0
    p = start
    for t in range(n):
        predicted[t] = p
        top = log_b[t].max()
        w = p * np.exp(log_b[t] - top)
        s = w.sum()
        filtered[t] = w / s if s > 0 else np.full(k, 1 / k)
        total += math.log(max(s, 1e-300)) + top
        p = filtered[t] @ trans
    return filtered, predicted, total


def _blocks(x: np.ndarray, size: int, fill: float) -> np.ndarray:
    """(blocks, size, columns) of the rows of x, the last block filled up."""
    n = -(-len(x) // size)
    return np.concatenate([x, np.full((n * size - len(x), x.shape[1]), fill)]).reshape(n, size, -1)


def forward(log_b: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(filtered, predicted, log-likelihood) of a hidden Markov chain with emission log densities (n, k).

    A step is a matrix, so the chain is cut into blocks that advance together: first the blocks' products, then the probabilities
    with which each block begins, then all steps within blocks. Two times the square root of n operations instead of n.
    """
    n, k = log_b.shape
    if n < 16:
        return forward_plain(log_b, trans, start)
    size = math.isqrt(n)
    top = log_b.max(axis=1)
    w = _blocks(np.exp(log_b - top[:, None]), size, 1.0)
    product = np.broadcast_to(np.eye(k), (len(w), k, k))
    for i in range(size):
        product = (product * w[:, i, None]) @ trans
        product = product / np.maximum(product.max(axis=(1, 2), keepdims=True), 1e-300)
    begin, p = np.empty((len(w), k)), start
    for b in range(len(w)):
        begin[b] = p
        p = p @ product[b]
        p = p / max(p.sum(), 1e-300)
    filtered, predicted, sums, p = np.empty_like(w), np.empty_like(w), np.empty(w.shape[:2]), begin
    for i in range(size):
        predicted[:, i] = p
        u = p * w[:, i]
        sums[:, i] = u.sum(axis=1)
        filtered[:, i] = u / np.maximum(sums[:, i, None], 1e-300)
        p = filtered[:, i] @ trans
    if not sums.reshape(-1)[:n].min() > 1e-200:
        return forward_plain(log_b, trans, start)
    return filtered.reshape(-1, k)[:n], predicted.reshape(-1, k)[:n], float(np.log(sums.reshape(-1)[:n]).sum() + top.sum())


def smooth(filtered: np.ndarray, predicted: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smoothed, expected transition counts) by the backward recursion, in blocks as forward().

    With r = smoothed / predicted it is linear: r[t] = filtered[t] / predicted[t] * (trans @ r[t + 1]).
    """
    n, k = filtered.shape
    size = math.isqrt(n)
    ratio = filtered / np.maximum(predicted, 1e-300)
    w, known = _blocks(ratio[::-1], size, 1.0), _blocks(predicted[::-1], size, 1.0 / k)
    w[0, 0] = 1.0
    step = np.tile(trans.T, (len(w), 1, 1))
    steps = [step.copy()] + [step] * (size - 1)
    steps[0][0] = np.eye(k)
    product = np.broadcast_to(np.eye(k), (len(w), k, k))
    for i in range(size):
        product = product @ steps[i] * w[:, i, None]
        product = product / np.maximum(product.max(axis=(1, 2), keepdims=True), 1e-300)
    begin, p = np.empty((len(w), k)), ratio[-1]
    for b in range(len(w)):
        begin[b] = p
        p = p @ product[b]
        p = p / max((p * known[b, -1]).sum(), 1e-300)
    r, p = np.empty_like(w), begin
    for i in range(size):
        p = (p[:, None] @ steps[i])[:, 0] * w[:, i]
        p = p / np.maximum((p * known[:, i]).sum(axis=1, keepdims=True), 1e-300)
        r[:, i] = p
    r = r.reshape(-1, k)[:n][::-1]
    smoothed = predicted * r
    return smoothed / smoothed.sum(axis=1, keepdims=True), trans * (filtered[:-1].T @ (r[1:] / np.maximum((filtered[:-1] @ trans * r[1:]).sum(axis=1, keepdims=True), 1e-300)))


def start_means(x: np.ndarray, k: int) -> np.ndarray:
    return np.quantile(x, np.linspace(0.1, 0.9, k), axis=0)


def regime_order(means: np.ndarray, variances: np.ndarray | None = None) -> np.ndarray:
    """state -> regime: states ranked by mean over volatility of the first feature (or mean alone), the best is 0."""
    score = means[:, 0] / np.sqrt(np.maximum(variances, 1e-12)) if variances is not None else means[:, 0]
    out = np.empty(len(score), int)
    out[np.argsort(-score, kind="stable")] = np.arange(len(score))
    return out


def fit_hmm(x: np.ndarray, k: int = 5, rounds: int = 60, floor: float = 1e-3, tolerance: float = 1e-4) -> dict:
    """Gaussian hidden Markov model with full covariances by expectation maximization."""
    n, d = x.shape
    means, covs = start_means(x, k), np.array([np.cov(x.T).reshape(d, d) + floor * np.eye(d)] * k)
    trans, start, before = np.full((k, k), 0.1 / (k - 1)), np.full(k, 1 / k), -np.inf
    np.fill_diagonal(trans, 0.9)
    for _ in range(rounds):
        log_b = np.stack([gaussian_log(x, means[j], covs[j]) for j in range(k)], axis=1)
        filtered, predicted, ll = forward(log_b, trans, start)
        g, counts = smooth(filtered, predicted, trans)
        if abs(ll - before) < tolerance * max(1, abs(ll)) * 1e-3:
            break
        before = ll
        start = g[0] / g[0].sum()
        trans = (counts + 1e-6) / (counts + 1e-6).sum(1, keepdims=True)
        for j in range(k):
            w = g[:, j]
            if w.sum() > 1e-6:
                means[j] = w @ x / w.sum()
                c = x - means[j]
                covs[j] = (w[:, None] * c).T @ c / w.sum() + floor * np.eye(d)
    parameters = (k - 1) + k * (k - 1) + k * d + k * d * (d + 1) / 2
    return {"means": means, "covs": covs, "trans": trans, "start": start, "ll": ll, "aic": 2 * parameters - 2 * ll, "bic": parameters * math.log(n) - 2 * ll, "order": regime_order(means, covs[:, 0, 0])}


def hmm_proba(x: np.ndarray, m: dict, causal: bool = False) -> np.ndarray:
    log_b = np.stack([gaussian_log(x, a, c) for a, c in zip(m["means"], m["covs"], strict=True)], axis=1)
    filtered, predicted, _ = forward(log_b, m["trans"], m["start"])
    p = filtered if causal else smooth(filtered, predicted, m["trans"])[0]
    out = np.empty_like(p)
    out[:, m["order"]] = p
    return out


def sample_states(log_b: np.ndarray, trans: np.ndarray, start: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
    """Forward filtering, backward sampling."""
    filtered, _, _ = forward(log_b, trans, start)
    n, k = filtered.shape
    u = rng.rand(n)
    last = min(int(np.searchsorted(filtered[-1].cumsum(), u[-1])), k - 1)
    w = filtered[:, None, :] * trans.T[None]
    cum = (w / np.maximum(w.sum(axis=2, keepdims=True), 1e-300)).cumsum(axis=2)
    earlier = np.minimum((cum < u[:, None, None]).sum(axis=2), k - 1).tolist()
    states = [last]
    for t in range(n - 2, -1, -1):
        states.append(earlier[t][states[-1]])
    return np.array(states[::-1])


def inverse_wishart(nu: float, psi: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
    d = len(psi)
    chol = np.linalg.cholesky(np.linalg.inv(psi))
    a = np.tril(rng.normal(size=(d, d)), -1)
    a[np.diag_indices(d)] = np.sqrt([rng.chisquare(nu - i) for i in range(d)])
    z = chol @ a
    return np.linalg.inv(z @ z.T)


def gibbs_hmm(x: np.ndarray, seed: int, k: int = 5, rounds: int = 400, burn: int = 150, alpha: float = 1.0, kappa: float = 10.0) -> dict:
    """Sticky Bayesian hidden Markov model: draws of means, covariances and transitions after the burn-in."""
    rng = np.random.RandomState(seed)
    n, d = x.shape
    means, covs = start_means(x, k), np.array([0.1 * np.eye(d)] * k)
    trans, start = np.full((k, k), 0.1 / (k - 1)), np.full(k, 1 / k)
    np.fill_diagonal(trans, 0.9)
    psi0, kept = 0.1 * np.eye(d), {"means": [], "covs": [], "trans": []}
    for it in range(rounds):
        log_b = np.maximum(np.stack([gaussian_log(x, means[j], covs[j], 1e-9) for j in range(k)], axis=1), math.log(1e-12))
        s = sample_states(log_b, trans, start, rng)
        counts = np.zeros((k, k))
        np.add.at(counts, (s[:-1], s[1:]), 1)
        trans = np.array([rng.dirichlet(alpha + kappa * np.eye(k)[i] + counts[i]) for i in range(k)])
        for j in range(k):
            y = x[s == j]
            m = len(y)
            mean = y.mean(0) if m else np.zeros(d)
            psi = psi0 + ((y - mean).T @ (y - mean) if m else 0) + m / (1 + m) * np.outer(mean, mean)
            covs[j] = inverse_wishart(d + 2 + m, psi, rng)
            means[j] = rng.multivariate_normal(m * mean / (1 + m), covs[j] / (1 + m))
        if it >= burn:
            for name, v in (("means", means), ("covs", covs), ("trans", trans)):
                kept[name].append(v.copy())
    return {name: np.array(v) for name, v in kept.items()}


def gelman_rubin(chains: np.ndarray) -> float:
    m, n = chains.shape
    if m < 2 or n < 10:
        return 1.0
    within = chains.var(1, ddof=1).mean()
    between = n * chains.mean(1).var(ddof=1)
    return float(math.sqrt(((n - 1) / n * within + between / n) / within)) if within > 0 else 1.0


def effective_size(x: np.ndarray, floor: float = 10.0) -> float:
    n, c = len(x), x - x.mean()
    var = (c**2).mean()
    total = 0.0
    for lag in range(1, min(n // 2, 40)):
        rho = (c[:-lag] * c[lag:]).mean() / var if var > 0 else 0.0
        if rho < 0.05:
            break
        total += rho
    return max(floor, n / (1 + 2 * total))


def fit_rsvar(x: np.ndarray, k: int = 5, lag: int = 1, rounds: int = 60) -> dict:
    """Regime-switching vector autoregression: Hamilton filter, Kim smoother, weighted least squares."""
    y, z = x[lag:], np.column_stack([np.ones(len(x) - lag), *(x[lag - i : len(x) - i] for i in range(1, lag + 1))])
    d = x.shape[1]
    base = np.linalg.lstsq(z, y, rcond=None)[0]
    spread = np.linspace(-1, 1, k)[:, None] * y.std(0)
    coef = np.array([base + np.vstack([s, np.zeros((z.shape[1] - 1, d))]) for s in spread])
    covs = np.array([np.cov(y.T).reshape(d, d) + 1e-4 * np.eye(d)] * k)
    trans, start = np.full((k, k), 0.1 / (k - 1)), np.full(k, 1 / k)
    np.fill_diagonal(trans, 0.9)
    ll = -np.inf
    for _ in range(rounds):
        log_b = np.stack([gaussian_log(y - z @ coef[j], np.zeros(d), covs[j]) for j in range(k)], axis=1)
        filtered, predicted, ll_new = forward(log_b, trans, start)
        g, counts = smooth(filtered, predicted, trans)
        done, ll = abs(ll_new - ll) < 1e-6 * abs(ll_new), ll_new
        trans = (counts + 1e-6) / (counts + 1e-6).sum(1, keepdims=True)
        for j in range(k):
            w = g[:, j]
            if w.sum() > 1e-6:
                zw = z * w[:, None]
                coef[j] = np.linalg.lstsq(zw.T @ z + 1e-8 * np.eye(z.shape[1]), zw.T @ y, rcond=None)[0]
                e = y - z @ coef[j]
                covs[j] = (w[:, None] * e).T @ e / w.sum() + 1e-4 * np.eye(d)
        if done:
            break
    return {"coef": coef, "covs": covs, "trans": trans, "start": start, "ll": ll, "lag": lag, "order": regime_order(coef[:, 0, :])}


def rsvar_proba(x: np.ndarray, m: dict) -> np.ndarray:
    """Causal probabilities; the first rows, without lags, are uniform."""
    lag, k = m["lag"], len(m["coef"])
    y, z = x[lag:], np.column_stack([np.ones(len(x) - lag), *(x[lag - i : len(x) - i] for i in range(1, lag + 1))])
    log_b = np.stack([gaussian_log(y - z @ c, np.zeros(x.shape[1]), v) for c, v in zip(m["coef"], m["covs"], strict=True)], axis=1)
    out = np.full((len(x), k), 1 / k)
    out[lag:, m["order"]] = forward(log_b, m["trans"], m["start"])[0]
    return out


def gibbs_regression(x: np.ndarray, y: np.ndarray, seed: int, scale: np.ndarray | None = None, rounds: int = 1000, burn: int = 200) -> np.ndarray:
    """Draws of the coefficients of y on the columns of x; scale: deviations of their normal priors around 0 (infinite: flat)."""
    return regression_chain(x, y, seed, scale, rounds, burn)[0]


def regression_chain(x: np.ndarray, y: np.ndarray, seed: int, scale: np.ndarray | None = None, rounds: int = 1000, burn: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The draws of gibbs_regression() and the mean that each was drawn around, whose average has less noise than that of the draws."""
    rng = np.random.RandomState(seed)
    n, d = x.shape
    precision = np.zeros((d, d)) if scale is None else np.diag(1 / scale**2)
    xx, xy, var, out, centres = x.T @ x, x.T @ y, float(y.var()) + 1e-12, [], []
    for it in range(rounds):
        cov = np.linalg.inv(xx / var + precision + 1e-12 * np.eye(d))
        centre = cov @ (xy / var)
        b = rng.multivariate_normal(centre, cov)
        var = float(((y - x @ b) ** 2).sum() / 2 + 1e-12) / rng.gamma(n / 2)
        if it >= burn:
            out.append(b)
            centres.append(centre)
    return np.array(out), np.array(centres)


def gibbs_mixture(x: np.ndarray, seed: int, k: int = 5, rounds: int = 600, burn: int = 200) -> dict:
    """Mixture of normal distributions on one feature, by Gibbs sampling: draws of weights, means and deviations, means ascending."""
    rng = np.random.RandomState(seed)
    n, scale = len(x), x.std() + 1e-12
    mu, sd, w = np.quantile(x, np.linspace(0.1, 0.9, k)), np.full(k, scale), np.full(k, 1 / k)
    kept = []
    for it in range(rounds):
        logs = np.log(w) - np.log(sd) - 0.5 * ((x[:, None] - mu) / sd) ** 2
        p = np.exp(logs - logs.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        s = np.minimum((p.cumsum(1) < rng.rand(n, 1)).sum(1), k - 1)
        count = np.bincount(s, minlength=k)
        w = rng.dirichlet(1 + count)
        for j in range(k):
            y = x[s == j]
            var = 1 / (len(y) / sd[j] ** 2 + 1 / (4 * scale**2))
            mu[j] = rng.normal(var * y.sum() / sd[j] ** 2, math.sqrt(var))
            sd[j] = math.sqrt((0.5 * scale**2 + 0.5 * ((y - mu[j]) ** 2).sum()) / rng.gamma(2 + len(y) / 2))
        order = np.argsort(mu)
        mu, sd, w = mu[order], sd[order], w[order]
        if it >= burn:
            kept.append((w.copy(), mu.copy(), sd.copy()))
    return {name: np.array([d[i] for d in kept]) for i, name in enumerate(("weights", "means", "sds"))}


def psis(ll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected log predictive density, Pareto k) of each observation from (draws, observations) by Pareto-smoothed importance sampling."""
    s, n = ll.shape
    out, shape = np.zeros(n), np.zeros(n)
    tail = int(min(0.2 * s, 3 * math.sqrt(s)))
    for i in range(n):
        r = -ll[:, i]
        r = r - r.max()
        order = np.argsort(r)
        top = order[-tail:]
        cut = math.exp(r[order[-tail - 1]]) if tail < s else 0.0
        x = np.exp(r[top]) - cut
        k = np.inf
        if tail >= 5 and x[-1] > 0 and np.ptp(x) > 0:
            k, sigma = _pareto(np.maximum(x, 1e-300))
            q = (np.arange(tail) + 0.5) / tail
            smoothed = cut + (sigma * (np.power(1 - q, -k) - 1) / k if abs(k) > 1e-9 else -sigma * np.log1p(-q))
            r[top] = np.minimum(np.log(np.maximum(smoothed, 1e-300)), 0.0)
        w = r - (np.log(np.exp(r - r.max()).sum()) + r.max())
        v = w + ll[:, i]
        out[i], shape[i] = np.log(np.exp(v - v.max()).sum()) + v.max(), k
    return out, shape


def _pareto(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalized Pareto tail by the empirical Bayes estimate of Zhang and Stephens."""
    n = len(x)
    m = 30 + int(math.sqrt(n))
    b = 1 / x[-1] + (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * x[int(n / 4 + 0.5) - 1])
    k = np.log1p(-b[:, None] * x[None]).mean(1)
    log_l = n * (np.log(np.maximum(-b / k, 1e-300)) - k - 1)
    w = 1 / np.exp(log_l[None] - log_l[:, None]).sum(1)
    beta = (b * w).sum() / w.sum()
    k = np.log1p(-beta * x).mean()
    return float((n * k + 5) / (n + 10)), float(-k / beta)


def segment_cost(x: np.ndarray, kind: str):
    """cost(starts, end) of normal segments, twice the negative log-likelihood but for constants. `mean_variance`: both are a
    segment's own; `variance`: the mean is that of all of x."""
    x = x - x.mean() if kind == "variance" else x
    s1, s2 = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x**2)]
    if kind not in ("mean_variance", "variance"):
        raise ValueError(f"no such cost: {kind}")

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        m = b - a
        centre = 0.0 if kind == "variance" else (s1[b] - s1[a]) / m
        return m * np.log(np.maximum((s2[b] - s2[a]) / m - centre**2, 1e-12))

    return cost


def pelt(x: np.ndarray, penalty: float | str | None = None, least: int = 10, kind: str = "mean_variance") -> list[int]:
    """Ends of the segments of at least `least` rows with the least penalized cost (pruned exact search); see segment_cost() for kinds.

    penalty is a number for each segment (None: three times the logarithm of the length), or `mbic`: the logarithm of the length for
    each parameter and two more, and that of its own length for each segment. A start that is beaten at t stays open for
    `least` more rows, as only then may a segment have begun at t; under `mbic` the bound allows for the lengths' logarithms.
    """
    n, modified = len(x), penalty == "mbic"
    value = (2 + (2 if kind == "mean_variance" else 1)) * math.log(max(n, 1)) if modified else 3 * math.log(max(n, 1)) if penalty is None else penalty
    slack = max(0.0, math.log(max(n, 1) / 4)) if modified else 0.0
    cost = segment_cost(x, kind) if n else None
    best, last, open_, until = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0]), np.full(n + 1, n + 1)
    best[0] = -value
    for t in range(least, n + 1):
        usable = open_[t - open_ >= least]
        c = best[usable] + cost(usable, t) + value + (np.log(t - usable) if modified else 0.0)
        i = int(np.argmin(c))
        best[t], last[t] = c[i], usable[i]
        beaten = usable[c - value - slack > best[t]]
        until[beaten] = np.minimum(until[beaten], t + least)
        open_ = np.unique(np.r_[open_[until[open_] > t + 1], t - least + 1])
        open_ = open_[np.isfinite(best[open_])]
    out, t = [], n
    while t > 0:
        out.append(t)
        t = int(last[t])
    return out[::-1]


class Network:
    """A two-layer classifier with Adam; dropout or Gaussian weights make it Bayesian."""

    def __init__(self, d: int, seed: int, sizes: tuple[int, ...] = (32, 16), k: int = 5, dropout: float = 0.0, variational: bool = False):
        self.rng = np.random.RandomState(seed)
        widths = (d, *sizes, k)
        self.w = [self.rng.normal(0, math.sqrt(2 / a), (a, b)) for a, b in zip(widths, widths[1:], strict=False)]
        self.b = [np.zeros(b) for b in widths[1:]]
        self.rho = [np.full(w.shape, -4.0) for w in self.w] if variational else None
        self.dropout = dropout

    def run(self, x: np.ndarray, sample: bool) -> tuple[np.ndarray, list]:
        h, kept = x, []
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            eps = self.rng.normal(size=w.shape) if self.rho is not None and sample else None
            used = w + np.log1p(np.exp(self.rho[i])) * eps if eps is not None else w
            z = h @ used + b
            mask = None
            if i < len(self.w) - 1:
                out = np.maximum(z, 0)
                if self.dropout and sample:
                    mask = (self.rng.rand(*out.shape) >= self.dropout) / (1 - self.dropout)
                    out = out * mask
            else:
                e = np.exp(z - z.max(1, keepdims=True))
                out = e / e.sum(1, keepdims=True)
            kept.append((h, used, z, mask, eps))
            h = out
        return h, kept

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 150, rate: float = 0.01, kl_weight: float = 0.01) -> float:
        params = self.w + self.b + (self.rho or [])
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        loss, n, layers = 0.0, len(x), len(self.w)
        for t in range(1, epochs + 1):
            p, kept = self.run(x, True)
            loss = float(-(y * np.log(np.maximum(p, 1e-12))).sum(1).mean())
            delta, gw, gb, gr = (p - y) / n, [None] * layers, [None] * layers, [None] * layers
            for i in range(layers - 1, -1, -1):
                h, used, _, _, eps = kept[i]
                gw[i], gb[i] = h.T @ delta, delta.sum(0)
                if self.rho is not None:
                    sd = np.log1p(np.exp(self.rho[i]))
                    slope = 1 / (1 + np.exp(-self.rho[i]))
                    gr[i] = (gw[i] * eps + kl_weight / n * (sd - 1 / sd)) * slope
                    gw[i] = gw[i] + kl_weight / n * self.w[i]
                if i:
                    delta = delta @ used.T
                    if kept[i - 1][3] is not None:
                        delta = delta * kept[i - 1][3]
                    delta = delta * (kept[i - 1][2] > 0)
            for q, g, a, b in zip(params, gw + gb + (gr if self.rho is not None else []), m, v, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return loss

    def sample(self, x: np.ndarray, passes: int) -> np.ndarray:
        return np.array([self.run(x, self.dropout > 0 or self.rho is not None)[0] for _ in range(passes)])
