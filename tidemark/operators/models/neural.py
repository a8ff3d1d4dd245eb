"""Neural ensembles and embedding probes. Members of an ensemble are groups of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import Network


#: Forward passes of all members together.
PASSES = {"deep": 1, "dropout": 100, "variational": 50}


def network_posterior(targets: DataFrame, columns: list[str], kind: str = "deep", members: int = 5, passes: int | None = None, epochs: int = 100, seed: int = 42) -> DataFrame:
    """(panel, date, model, p, total_entropy, aleatoric, epistemic) of an ensemble fitted to soft targets: (panel, date, columns..., p).

    kind: `deep` (plain members), `dropout` (Monte Carlo dropout) or `variational` (Gaussian weights). Members take part in
    `passes` forward passes each, by default so that all members together make PASSES. Only rows whose split is 'train'
    are fitted if there is a column split.
    """
    passes = passes or -(-PASSES[kind] // members)
    has_split = "split" in targets.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x, y = pdf[columns].to_numpy(float), np.array(pdf["p"].tolist())
        fit = (pdf["split"] == "train").to_numpy() if has_split else np.ones(len(x), bool)
        z = (x - x[fit].mean(0)) / (x[fit].std(0) + 1e-8)
        net = Network(x.shape[1], seed + int(pdf["member"].iloc[0]), (16,) if kind == "variational" else (32, 16), dropout=0.2 if kind == "dropout" else 0.0, variational=kind == "variational")
        net.fit(z[fit], y[fit], epochs=epochs)
        ps = net.sample(z, 1 if kind == "deep" else passes)
        own = -(ps * np.log(np.maximum(ps, 1e-12))).sum(-1).mean(0)
        return pd.DataFrame({"panel": pdf["panel"].to_numpy(), "date": pdf["date"].to_numpy(), "q": list(ps.mean(0)), "h": own})

    data = targets.select("panel", "date", *columns, "p", *(["split"] if has_split else [])).na.drop().withColumn("member", F.explode(F.array(*(F.lit(i) for i in range(members)))))
    each = data.groupBy("panel", "member").applyInPandas(run, "panel string, date date, q array<double>, h double")
    per = each.groupBy("panel", "date").agg(F.array(*(F.avg(F.get("q", F.lit(k))) for k in range(5))).alias("p"), F.avg("h").alias("aleatoric"))
    total = -F.aggregate("p", F.lit(0.0), lambda a, x: a + x * F.log(F.greatest(x, F.lit(1e-12))))
    return per.select("panel", "date", F.lit(kind).alias("model"), "p", total.alias("total_entropy"), "aleatoric", F.greatest(F.lit(0.0), total - F.col("aleatoric")).alias("epistemic"))


def embeddings(features: DataFrame, column: str, context: int = 64, dims: int = 16, patch: int | None = None, seed: int = 42) -> DataFrame:
    """(panel, date, embedding): random projection of the standardized window before each row (of its last `patch` values), tanh. Rows without a full window are left out."""
    w = Window.partitionBy("panel").orderBy("date").rowsBetween(-context, -1)
    rows = features.filter(F.col(column).isNotNull()).select("panel", "date", F.collect_list(column).over(w).alias("window")).filter(F.size("window") == context)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.RandomState(seed)
        matrix = rng.normal(size=(patch, dims)) / np.sqrt(patch) if patch else np.linalg.qr(rng.normal(size=(context, dims)))[0]
        for pdf in parts:
            x = np.array(pdf["window"].tolist(), float).reshape(len(pdf), context)
            z = (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-8)
            yield pdf[["panel", "date"]].assign(embedding=list(np.tanh((z[:, -patch:] if patch else z) @ matrix)))

    return rows.mapInPandas(run, "panel string, date date, embedding array<double>")


def probe(embedded: DataFrame, labels: DataFrame, c: float = 1.0, train_before: str | None = None) -> DataFrame:
    """(panel, date, y, predicted, p) of a multinomial logistic regression on embeddings with an L2 penalty; classes that don't occur have probability 0.

    With `train_before` it is fitted on the rows before that date and predicts the others alone.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = embedded.join(labels.filter("y is not null"), ["panel", "date"]).select("panel", "date", F.col("y").cast("double").alias("y"), array_to_vector("embedding").alias("x"))
    early = F.col("date") < F.lit(train_before).cast("date") if train_before else F.lit(True)
    known = rows.filter(early).persist()
    try:
        n = known.count()
        model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1 / (c * max(n, 1)), standardization=False, maxIter=100).fit(known)
    finally:
        known.unpersist()
    out = model.transform(rows.filter(~early) if train_before else rows).select("panel", "date", "y", F.col("prediction").alias("predicted"), vector_to_array("probability").alias("q"))
    return out.select("panel", "date", F.col("y").cast("int").alias("y"), F.col("predicted").cast("int").alias("predicted"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.coalesce(F.get("q", k), F.lit(0.0))).alias("p"))


def silhouettes(points: DataFrame, block: int = 1024) -> DataFrame:
    """(id, y, own, other, silhouette) of every row of (id, y, embedding), ids distinct: mean distances to its own class and to the nearest other one.

    Rows are dealt to blocks of about `block` rows by hash; a task gets two blocks and sums each row's distances to the classes
    of the other, so it holds no more than the distances of one block to another, and no row is left out. A row alone in
    its class has 0, and so have all rows where there is one class.
    """
    n = points.count()
    blocks = max(1, -(-n // block))
    dealt = points.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt.select("id", "y", "embedding", F.col("_b").alias("i"), every.alias("j"))
    right = dealt.select(F.col("y").alias("c"), F.col("embedding").alias("other"), F.col("_b").alias("j"), every.alias("i"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["id", "y", "c", "total", "n"])
        p, q = np.array(a["embedding"].tolist()), np.array(b["other"].tolist())
        # Differences, not products of norms: equal rows have distance 0.
        d = np.sqrt(sum(((p[:, k, None] - q[None, :, k]) ** 2 for k in range(p.shape[1])), np.zeros((len(p), len(q)))))
        classes, of = np.unique(b["c"].to_numpy(), return_inverse=True)
        one = np.eye(len(classes))[of]
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), len(classes)), "y": np.repeat(a["y"].to_numpy(), len(classes)), "c": np.tile(classes, len(a)), "total": (d @ one).ravel(), "n": np.tile(one.sum(0), len(a)).astype(int)})

    part = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(sums, f"id {points.schema['id'].dataType.simpleString()}, y int, c int, total double, n long")
    whole = part.groupBy("id", "y", "c").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = whole.groupBy("id", "y").agg(F.max(F.when((F.col("c") == F.col("y")) & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("own"), F.min(F.when(F.col("c") != F.col("y"), F.col("total") / F.col("n"))).alias("other"))
    top = F.greatest("own", "other")
    return mean.select("id", "y", "own", "other", F.when(F.col("own").isNotNull() & F.col("other").isNotNull() & (top > 0), (F.col("other") - F.col("own")) / top).otherwise(0.0).alias("silhouette"))


def separation(embedded: DataFrame, labels: DataFrame, block: int = 1024) -> DataFrame:
    """One row: mean silhouette over all rows, Calinski-Harabasz and Davies-Bouldin scores. Of the rows only sums by class reach the driver."""
    rows = embedded.join(labels.filter("y is not null"), ["panel", "date"]).select("panel", "date", "y", "embedding")
    dims = range(len(rows.select("embedding").first()[0]))
    x = [F.get("embedding", F.lit(i)) for i in dims]
    per = rows.groupBy("y").agg(F.count("*").alias("n"), F.array(*(F.avg(v) for v in x)).alias("centre"), F.array(*(F.var_pop(v) for v in x)).alias("var"))
    spread = rows.join(per, "y").withColumn("d", F.sqrt(F.aggregate(F.zip_with("embedding", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v))).groupBy("y").agg(F.avg("d").alias("s"))
    groups = per.join(spread, "y").orderBy("y").toPandas()
    centre, n, s = np.array(groups["centre"].tolist()), groups["n"].to_numpy(float), groups["s"].to_numpy(float)
    mean = (n[:, None] * centre).sum(0) / n.sum()
    between, within = (n * ((centre - mean) ** 2).sum(1)).sum(), (n[:, None] * np.array(groups["var"].tolist())).sum()
    k = len(n)
    d = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(-1))
    bouldin = float(np.mean([max((s[i] + s[j]) / d[i, j] for j in range(k) if j != i) for i in range(k)])) if k > 1 else 0.0
    found = silhouettes(rows.select(F.concat_ws("|", "panel", "date").alias("id"), F.col("y").cast("int").alias("y"), "embedding"), block)
    row = (float(between / max(k - 1, 1) / (within / max(n.sum() - k, 1))), bouldin)
    return found.agg(F.avg("silhouette").alias("silhouette")).select("silhouette", F.lit(row[0]).alias("calinski_harabasz"), F.lit(row[1]).alias("davies_bouldin"))
