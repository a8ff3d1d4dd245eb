"""Latent-state models over feature tables (panel, date, features...). A group is a panel, or a panel and a chain."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hamiltonian
from . import kernels as K

PROBA = "panel string, date date, model string, p array<double>"


def _known(pdf: pd.DataFrame, until: str | None) -> np.ndarray:
    """Which rows a model may learn from: those before `until`, all if it is None."""
    return np.ones(len(pdf), bool) if until is None else (pd.to_datetime(pdf["date"]) < pd.Timestamp(until)).to_numpy()


def _matrix(pdf: pd.DataFrame, columns: list[str], scale: bool, until: str | None = None) -> np.ndarray:
    """The columns, if asked for scaled by means and deviations of the rows before `until`."""
    x = pdf[columns].to_numpy(float)
    known = x[_known(pdf, until)]
    return (x - known.mean(0)) / (known.std(0) + 1e-8) if scale else x


def _rows(pdf: pd.DataFrame, model: str, p: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"panel": pdf["panel"].to_numpy(), "date": pdf["date"].to_numpy(), "model": model, "p": list(p)})


def posterior(features: DataFrame, columns: list[str], model: str = "hmm", causal: bool = True, rounds: int = 60, until: str | None = None) -> DataFrame:
    """(panel, date, model, p) of a fitted `hmm`, `rsvar` or `mixture` (the last on the first column alone). Rows with a null are left out.

    causal: the filter, which later rows can't change given the fit; otherwise the smoother. Scaling and fit use the rows before
    `until` alone (all by default), so that with it no later row changes anything before it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x = _matrix(pdf, columns, model != "mixture", until)
        known = x[_known(pdf, until)]
        if model == "hmm":
            p = K.hmm_proba(x, K.fit_hmm(known, rounds=rounds), causal)
        elif model == "rsvar":
            p = K.rsvar_proba(x, K.fit_rsvar(known, rounds=rounds))
        else:
            d = K.gibbs_mixture(known[:, 0], seed=42, rounds=5 * rounds, burn=2 * rounds)
            w, m, s = (d[n].mean(0) for n in ("weights", "means", "sds"))
            logs = np.log(w) - np.log(s) - 0.5 * ((x[:, :1] - m) / s) ** 2
            e = np.exp(logs - logs.max(1, keepdims=True))
            p = np.empty_like(e)
            p[:, K.regime_order(m[:, None], s**2)] = e / e.sum(1, keepdims=True)
        return _rows(pdf, model, p)

    return features.select("panel", "date", *columns).na.drop().groupBy("panel").applyInPandas(run, PROBA)


def diagnostics(features: DataFrame, columns: list[str], rounds: int = 60) -> DataFrame:
    """(panel, model, metric, value): likelihoods, information criteria and transition matrices of the fitted models."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, panel = _matrix(pdf.sort_values("date"), columns, True), pdf["panel"].iloc[0]
        out = []
        for name, m in (("hmm", K.fit_hmm(x, rounds=rounds)), ("rsvar", K.fit_rsvar(x, rounds=rounds))):
            out += [(panel, name, k, float(m[k])) for k in ("ll", "aic", "bic") if k in m]
            t = np.empty_like(m["trans"])
            t[np.ix_(m["order"], m["order"])] = m["trans"]
            out += [(panel, name, f"transition_{i}_{j}", float(t[i, j])) for i in range(len(t)) for j in range(len(t))]
        return pd.DataFrame(out, columns=["panel", "model", "metric", "value"])

    return features.select("panel", "date", *columns).na.drop().groupBy("panel").applyInPandas(run, "panel string, model string, metric string, value double")


def gibbs_draws(features: DataFrame, columns: list[str], chains: int = 2, rounds: int = 400, burn: int = 150, seed: int = 42, until: str | None = None) -> DataFrame:
    """(panel, chain, draw, state, mean, cov, trans): posterior draws as rows; chains are groups of their own, so they run in parallel.

    Only rows before `until` are used (all by default).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        panel, chain = pdf["panel"].iloc[0], int(pdf["chain"].iloc[0])
        d = K.gibbs_hmm(_matrix(pdf, columns, True, until)[_known(pdf, until)], seed + chain, rounds=rounds, burn=burn)
        rows = [(panel, chain, i, s, list(d["means"][i, s]), [list(r) for r in d["covs"][i, s]], list(d["trans"][i, s])) for i in range(len(d["means"])) for s in range(d["means"].shape[1])]
        return pd.DataFrame(rows, columns=["panel", "chain", "draw", "state", "mean", "cov", "trans"])

    data = features.select("panel", "date", *columns).na.drop().withColumn("chain", F.explode(F.array(*(F.lit(c) for c in range(chains)))))
    return data.groupBy("panel", "chain").applyInPandas(run, "panel string, chain int, draw int, state int, mean array<double>, cov array<array<double>>, trans array<double>")


def convergence(draws: DataFrame) -> DataFrame:
    """(panel, state, r_hat, ess, converged) of each state's first mean, states in ascending order of it within a draw."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([[np.sort(g["x"].to_numpy()) for _, g in c.groupby("draw")] for _, c in pdf.groupby("chain")])
        rows = [(pdf["panel"].iloc[0], s, K.gelman_rubin(x[:, :, s]), K.effective_size(x[:, :, s].ravel())) for s in range(x.shape[2])]
        return pd.DataFrame([(*r, r[2] < 1.05) for r in rows], columns=["panel", "state", "r_hat", "ess", "converged"])

    return draws.select("panel", "chain", "draw", F.get("mean", F.lit(0)).alias("x")).groupBy("panel").applyInPandas(run, "panel string, state int, r_hat double, ess double, converged boolean")


def gibbs_posterior(features: DataFrame, columns: list[str], draws: DataFrame, most: int = 50, until: str | None = None) -> DataFrame:
    """(panel, date, model, p, total_entropy, aleatoric, epistemic): filter averaged over the first draws of chain 0.

    `until` must be that of the draws: the columns are scaled as they were for them.
    """
    some = draws.filter((F.col("chain") == 0) & (F.col("draw") < most))

    def run(key: tuple, data: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("date")
        x, every = _matrix(data, columns, True, until), []
        for _, g in d.groupby("draw"):
            g = g.sort_values("state")
            m = {"means": np.array(g["mean"].tolist()), "covs": np.array([[list(r) for r in c] for c in g["cov"]]), "trans": np.array(g["trans"].tolist()), "start": np.full(len(g), 1 / len(g))}
            m["order"] = K.regime_order(m["means"])
            every.append(K.hmm_proba(x, m, causal=True))
        if not every:
            return pd.DataFrame(columns=["panel", "date", "model", "p", "total_entropy", "aleatoric", "epistemic"])
        ps = np.array(every)
        p = ps.mean(0)
        entropy = lambda q: -(q * np.log(np.maximum(q, 1e-12))).sum(-1)
        total, own = entropy(p), entropy(ps).mean(0)
        return _rows(data, "gibbs", p).assign(total_entropy=total, aleatoric=own, epistemic=np.maximum(total - own, 0))

    data = features.select("panel", "date", *columns).na.drop()
    return data.groupBy("panel").cogroup(some.groupBy("panel")).applyInPandas(run, PROBA + ", total_entropy double, aleatoric double, epistemic double")


def mixture_draws(features: DataFrame, column: str, draws: int = 100, seed: int = 42) -> DataFrame:
    """(panel, model, draw, parts): posterior draws of mixtures of 2 to 4 components, parts as (weight, mean, sd)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, x = int(pdf["k"].iloc[0]), pdf.sort_values("date")[column].to_numpy(float)
        d = K.gibbs_mixture(x, seed, k=k, rounds=100 + draws, burn=100)
        parts = [[{"w": w, "m": m, "s": s} for w, m, s in zip(*row, strict=True)] for row in zip(*(d[n].tolist() for n in ("weights", "means", "sds")), strict=True)]
        return pd.DataFrame({"panel": pdf["panel"].iloc[0], "model": f"mixture_{k}", "draw": np.arange(draws), "parts": parts})

    data = features.select("panel", "date", column).na.drop().withColumn("k", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))))
    return data.groupBy("panel", "k").applyInPandas(run, "panel string, model string, draw long, parts array<struct<w:double,m:double,s:double>>")


def mixture_chains(features: DataFrame, column: str, chains: int = 2, components: int = 5, rounds: int = 400, burn: int = 150, seed: int = 42) -> DataFrame:
    """(panel, chain, draw, mean) of chains of the mixture's sampler, for convergence(); mean holds one component's mean, in ascending order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = int(pdf["chain"].iloc[0])
        d = K.gibbs_mixture(pdf.sort_values("date")[column].to_numpy(float), seed + chain, k=components, rounds=rounds, burn=burn)["means"]
        draw, part = np.indices(d.shape)
        return pd.DataFrame({"panel": pdf["panel"].iloc[0], "chain": chain, "draw": draw.ravel(), "state": part.ravel(), "mean": [[v] for v in d.ravel()]})

    data = features.select("panel", "date", column).na.drop().withColumn("chain", F.explode(F.array(*(F.lit(c) for c in range(chains)))))
    return data.groupBy("panel", "chain").applyInPandas(run, "panel string, chain int, draw int, state int, mean array<double>")


def marginal_likelihood(features: DataFrame, columns: list[str], draws: DataFrame, most: int = 50) -> DataFrame:
    """(panel, draw, log_likelihood): of the whole series under each of the first draws of chain 0, states summed out by the forward recursion."""
    some = draws.filter((F.col("chain") == 0) & (F.col("draw") < most))

    def run(key: tuple, data: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        x, out = _matrix(data.sort_values("date"), columns, True) if len(data) else None, []
        for draw, g in d.groupby("draw") if x is not None else []:
            g = g.sort_values("state")
            covs = [np.array([list(r) for r in c]) for c in g["cov"]]
            log_b = np.stack([K.gaussian_log(x, np.array(list(m)), c) for m, c in zip(g["mean"], covs, strict=True)], axis=1)
            out.append((key[0], int(draw), K.forward(log_b, np.array(g["trans"].tolist()), np.full(len(g), 1 / len(g)))[2]))
        return pd.DataFrame(out, columns=["panel", "draw", "log_likelihood"])

    data = features.select("panel", "date", *columns).na.drop()
    return data.groupBy("panel").cogroup(some.groupBy("panel")).applyInPandas(run, "panel string, draw int, log_likelihood double")


def bayes_regression(rows: DataFrame, columns: list[str], target: str, prior_scale: float | None = None, chains: int = 2, rounds: int = 1000, burn: int = 200, seed: int = 42) -> DataFrame:
    """(panel, term, mean, sd, low, high, r_hat) of a normal linear regression by Gibbs sampling: the posterior's moments, its 2.5 and
    97.5 % points and the chains' agreement. The mean is that of the conditional means, so under a flat prior it is the least-squares estimate. The prior is flat, or normal with `prior_scale` deviations of the target for each deviation of a column."""
    terms = ["intercept", *columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y, x = pdf[target].to_numpy(float), np.column_stack([np.ones(len(pdf)), pdf[columns].to_numpy(float)])
        scale = None if prior_scale is None else np.r_[np.inf, prior_scale * y.std() / np.maximum(x[:, 1:].std(0), 1e-12)]
        b, centres = (np.stack(v) for v in zip(*(K.regression_chain(x, y, seed + c, scale, rounds, burn) for c in range(chains)), strict=True))
        flat = b.reshape(-1, len(terms))
        return pd.DataFrame({"panel": pdf["panel"].iloc[0], "term": terms, "mean": centres.mean((0, 1)), "sd": flat.std(0, ddof=1), "low": np.quantile(flat, 0.025, axis=0), "high": np.quantile(flat, 0.975, axis=0), "r_hat": [K.gelman_rubin(b[:, :, k]) for k in range(len(terms))]})

    return rows.select("panel", "date", target, *columns).na.drop().groupBy("panel").applyInPandas(run, "panel string, term string, mean double, sd double, low double, high double, r_hat double")


def mixture_log_likelihood(features: DataFrame, column: str, draws: DataFrame) -> DataFrame:
    """(panel, model, obs, draw, ll) of each row under each posterior draw of mixture_draws(); obs numbers a panel's dates."""
    rows = features.select("panel", "date", column).na.drop()
    rows = rows.select("panel", F.col(column).alias("x"), (F.row_number().over(Window.partitionBy("panel").orderBy("date")) - 1).cast("long").alias("obs"))
    logs = F.transform("parts", lambda c: F.log(c["w"]) - F.log(c["s"]) - 0.5 * F.pow((F.col("x") - c["m"]) / c["s"], 2) - 0.5 * math.log(2 * math.pi))
    both = rows.join(draws, "panel").select("panel", "model", "obs", "draw", logs.alias("logs")).withColumn("top", F.array_max("logs"))
    return both.select("panel", "model", "obs", "draw", (F.col("top") + F.log(F.aggregate("logs", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))))).alias("ll"))


def psis_loo(log_likelihood: DataFrame) -> DataFrame:
    """(panel, model, elpd_loo, se, k_good, k_ok, k_bad) by Pareto-smoothed importance sampling, observations in groups of their own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e, k = K.psis(pdf.pivot(index="draw", columns="obs", values="ll").to_numpy())
        return pd.DataFrame({"panel": pdf["panel"].iloc[0], "model": pdf["model"].iloc[0], "e": e, "k": k})

    per = log_likelihood.withColumn("block", F.floor(F.col("obs") / 500)).groupBy("panel", "model", "block").applyInPandas(run, "panel string, model string, e double, k double")
    share = lambda c: F.avg(c.cast("double"))
    return per.groupBy("panel", "model").agg(F.sum("e").alias("elpd_loo"), F.sqrt(F.count("*") * F.var_samp("e")).alias("se"), share(F.col("k") <= 0.5).alias("k_good"), share((F.col("k") > 0.5) & (F.col("k") <= 0.7)).alias("k_ok"), share(F.col("k") > 0.7).alias("k_bad"))


def changepoints(features: DataFrame, column: str, cost: str = "mean_variance", penalty: float | str | None = None) -> DataFrame:
    """(panel, segment, start_date, end_date, n, mean, sd) of segments of constant mean and variance, or of constant variance; see pelt()."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x, dates = pdf[column].to_numpy(float), pdf["date"].to_numpy()
        ends = K.pelt(x, penalty, kind=cost) if len(x) >= 20 else [len(x)]
        rows = [(pdf["panel"].iloc[0], i, dates[a], dates[b - 1], b - a, x[a:b].mean(), x[a:b].std()) for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
        return pd.DataFrame(rows, columns=["panel", "segment", "start_date", "end_date", "n", "mean", "sd"])

    return features.select("panel", "date", column).na.drop().groupBy("panel").applyInPandas(run, "panel string, segment int, start_date date, end_date date, n long, mean double, sd double")


def hamiltonian_chains(features: DataFrame, column: str, chains: int = 2, components: int = 2, warm_up: int = 300, draws: int = 300, seed: int = 42) -> DataFrame:
    """(panel, chain, draw, state, mean, weight, sd, diverged) of chains of the no-U-turn sampler on a normal mixture; a chain is a group.

    The columns that convergence() reads are as those of mixture_chains(), so both samplers are judged alike.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = int(pdf["chain"].iloc[0])
        d = hamiltonian.mixture(pdf.sort_values("date")[column].to_numpy(float), seed + chain, components, warm_up, draws)
        draw, part = np.indices(d["means"].shape)
        return pd.DataFrame({"panel": pdf["panel"].iloc[0], "chain": chain, "draw": draw.ravel(), "state": part.ravel(), "mean": [[v] for v in d["means"].ravel()], "weight": d["weights"].ravel(), "sd": d["sds"].ravel(), "diverged": np.repeat(d["diverged"], components)})

    data = features.select("panel", "date", column).na.drop().withColumn("chain", F.explode(F.array(*(F.lit(c) for c in range(chains)))))
    return data.groupBy("panel", "chain").applyInPandas(run, "panel string, chain int, draw int, state int, mean array<double>, weight double, sd double, diverged boolean")


def sampler_report(draws: DataFrame) -> DataFrame:
    """(panel, state, mean, r_hat, ess, n_divergent, converged) of hamiltonian_chains(): converged only without a divergence."""
    found = draws.groupBy("panel", "state").agg(F.avg(F.get("mean", F.lit(0))).alias("mean"), F.count_if("diverged").alias("n_divergent"))
    return convergence(draws).join(found, ["panel", "state"]).select("panel", "state", "mean", "r_hat", "ess", "n_divergent", (F.col("converged") & (F.col("n_divergent") == 0)).alias("converged"))
