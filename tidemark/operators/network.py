"""Correlation-graph and topological features over sliding windows that end before the row they are for."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .technical import W, correlation, log_return

NODES = ["bank", "it", "midcap", "broad", "bench"]
WIDTH = 60

def BEFORE():
    return W().rowsBetween(-WIDTH, -1)


GRAPH = ["gnn_spectral_radius", "gnn_algebraic_connectivity", "gnn_graph_entropy", "gnn_bank_centrality", "gnn_it_centrality", "gnn_emb_0", "gnn_emb_1", "gnn_emb_2", "gnn_emb_3"]
TOPOLOGY = ["tda_persistence_entropy_h0", "tda_persistence_entropy_h1", "tda_h0_amplitude", "tda_h1_max_lifetime", "tda_landscape_l1"]


def returns(panel: DataFrame, nodes: list[str] = NODES) -> DataFrame:
    """Log returns with nulls as zero."""
    return panel.select("panel", "date", *(F.coalesce(log_return(n, 1), F.lit(0.0)).alias(n) for n in nodes))


def adjacency(panel: DataFrame, nodes: list[str] = NODES) -> DataFrame:
    """Edges (panel, date, i, j, weight): positive part of the correlation of two nodes in the window before each date."""
    r = returns(panel, nodes)
    full = F.count("*").over(BEFORE()) == WIDTH
    pairs = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.greatest(F.lit(0.0), F.coalesce(correlation(a, b, BEFORE()), F.lit(0.0))).alias("weight")) for a, b in combinations(nodes, 2)]
    rows = r.select("panel", "date", full.alias("_full"), F.array(*pairs).alias("_e")).filter("_full")
    return rows.select("panel", "date", F.explode("_e").alias("e")).select("panel", "date", "e.*")


def _windows(panel: DataFrame, nodes: list[str]) -> DataFrame:
    r = returns(panel, nodes)
    rows = r.select("panel", "date", F.collect_list(F.array(*nodes)).over(BEFORE()).alias("window"))
    return rows.filter(F.size("window") == WIDTH)


def graph_metrics(x: np.ndarray, seed: int = 42) -> list[float]:
    """Spectral, entropy and embedding features of one window (rows: days, columns: nodes)."""
    n = x.shape[1]
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    a = np.maximum(np.nan_to_num(z.T @ z / len(x)), 0)
    np.fill_diagonal(a, 0)
    values, vectors = np.linalg.eigh(a)
    centre = np.abs(vectors[:, np.argmax(values)])
    centre = centre / centre.sum() if centre.sum() > 0 else np.full(n, 1 / n)
    laplacian = np.linalg.eigvalsh(np.diag(a.sum(1)) - a)
    share = laplacian / max(laplacian.sum(), 1e-12)
    share = share[share > 1e-10]
    rng = np.random.RandomState(seed)
    w0, w1 = rng.normal(0, 0.5, (3, 8)), rng.normal(0, 0.5, (8, 4))
    features = np.stack([x.mean(0) * 252, x.std(0) * np.sqrt(252), x[-1]], axis=1)
    loops = a + np.eye(n)
    root = 1 / np.sqrt(loops.sum(1))
    spread = root[:, None] * loops * root[None]
    hidden = np.maximum(spread @ features @ w0, 0)
    embedding = (spread @ hidden @ w1).mean(0)
    return [float(np.abs(values).max()), float(laplacian[1]), float(-(share * np.log(share)).sum()), float(centre[0]), float(centre[1]), *map(float, embedding)]


def tree_weights(d: np.ndarray) -> np.ndarray:
    """Edge weights of a minimum spanning tree, ascending, zeros left out (Prim)."""
    n = len(d)
    done, best, out = np.zeros(n, bool), d[0].copy(), []
    done[0] = True
    for _ in range(n - 1):
        k = int(np.argmin(np.where(done, np.inf, best)))
        out.append(best[k])
        done[k] = True
        best = np.minimum(best, d[k])
    w = np.sort(np.array(out))
    w = w[w > 0]
    return w if len(w) else np.zeros(1)


def cycle_lifetimes(d: np.ndarray, tree: np.ndarray, most: int = 20) -> np.ndarray:
    """Lifetimes of triangles among the first points at 1.5 times the longest tree edge."""
    limit, n = 1.5 * tree.max(), len(d)
    out = []
    for i in range(min(n, most)):
        for j in range(i + 1, min(n, most)):
            if d[i, j] <= limit:
                k = np.flatnonzero((d[i] <= limit) & (d[j] <= limit))
                k = k[(k != i) & (k != j)]
                if len(k):
                    peak = np.maximum(np.maximum(d[i, k], d[j, k]), d[i, j])
                    if peak.max() - peak.min() > 1e-4:
                        out.append(peak.max() - peak.min())
    return np.array(out) if out else np.array([0.01])


def loop_lifetimes(d: np.ndarray) -> np.ndarray:
    """Lifetimes, zeros left out, of the loops (H1, coefficients modulo 2) of the Vietoris-Rips filtration of all points.

    Coboundaries of edges (the triangles over them) are reduced, the longest edges first; the earliest triangle left is the one that
    fills an edge's loop. Edges that join two components are left out, as they make no loop; those that are the longest of a
    triangle are filled at once, so only the others are reduced. A triangle is known by its longest edge and the point across it. Beyond the
    least radius at which one point reaches all others the complex is a cone, so every loop is filled by then.
    """
    n = len(d)
    radius = d.max(1).min() if n else 0.0
    a, b = np.triu_indices(n, 1)
    near = d[a, b] <= radius
    a, b = a[near], b[near]
    order = np.argsort(d[a, b], kind="stable")
    a, b = a[order], b[order]
    length, rank = d[a, b], np.full((n, n), -1)
    rank[a, b] = rank[b, a] = np.arange(len(a))
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def over(e: int) -> set[int]:
        """The triangles over an edge, as numbers that order as they come."""
        i, j = int(a[e]), int(b[e])
        k = np.flatnonzero((rank[i] >= 0) & (rank[j] >= 0))
        x, y = rank[i, k], rank[j, k]
        across = np.where((x > e) & (x > y), j, np.where(y > e, i, k))
        return set((np.maximum(np.maximum(x, y), e) * n + across).tolist())

    loops = []
    for e, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(i), find(j)
        if x == y:
            loops.append(e)
        root[x] = y
    sides = np.maximum(rank[a], rank[b])
    filled = (rank[a] >= 0) & (rank[b] >= 0) & (sides < np.arange(len(a))[:, None])
    point = np.where(filled.any(axis=1), filled.argmax(axis=1), -1).tolist() if n else []
    columns, out = {e * n + point[e]: e for e in loops if point[e] >= 0}, []
    for e in reversed(loops):
        if point[e] >= 0:
            continue
        column = over(e)
        while column:
            first = min(column)
            if first not in columns:
                columns[first] = column
                if length[first // n] > length[e]:
                    out.append(length[first // n] - length[e])
                break
            other = columns[first]
            column = column ^ (over(other) if isinstance(other, int) else other)
    return np.array(sorted(out, reverse=True))


def persistence_entropy(lifetimes: np.ndarray) -> float:
    x = lifetimes[lifetimes > 1e-8]
    p = x / x.sum() if len(x) else x
    return float(-(p * np.log(p + 1e-12)).sum())


def _topology(x: np.ndarray, exact: bool = False) -> list[float]:
    """Features of one window. Loops are those of triangles among the first points, or with `exact` the filtration's own, all points'."""
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    d = np.sqrt(np.maximum(((z[:, None] - z[None]) ** 2).sum(-1), 0))
    tree = tree_weights(d)
    found = loop_lifetimes(d) if exact else cycle_lifetimes(d, tree)
    cycles = found if len(found) else np.zeros(1)
    top = np.sort(cycles)[::-1][:5]
    return [persistence_entropy(tree), persistence_entropy(cycles), float(tree.sum()), float(cycles.max()), float(0.5 * (top**2).sum())]


def topology_metrics(x: np.ndarray) -> list[float]:
    return _topology(x)


def _mapped(windows: DataFrame, fn, names: list[str]) -> DataFrame:
    """fn of each window. They come out of one task for each panel, so they are dealt out by date first."""
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [fn(np.array([list(r) for r in w], float)) for w in pdf["window"]]
            yield pd.concat([pdf[["panel", "date"]].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=float)], axis=1)

    return windows.repartition(n, "panel", "date").mapInPandas(run, "panel string, date date, " + ", ".join(f"{n} double" for n in names))


def graph_features(panel: DataFrame, nodes: list[str] = NODES) -> DataFrame:
    return _mapped(_windows(panel, nodes), graph_metrics, GRAPH)


def topology_features(panel: DataFrame, nodes: list[str] | None = None, step: int = 1, exact: bool = False) -> DataFrame:
    """With step > 1 only every step-th window is computed and its values are carried forward. exact: see _topology()."""
    topology_metrics = partial(_topology, exact=exact)
    windows = _windows(panel, nodes or ["bench", "midcap", "bank", "it"])
    if step == 1:
        return _mapped(windows, topology_metrics, TOPOLOGY)
    k = windows.withColumn("_k", F.row_number().over(W()) % step)
    found = _mapped(k.filter("_k = 1").drop("_k"), topology_metrics, TOPOLOGY)
    rows = windows.select("panel", "date").join(found, ["panel", "date"], "left")
    return rows.select("panel", "date", *(F.last(c, ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in TOPOLOGY))
