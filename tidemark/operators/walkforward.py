"""Walk-forward refits: rows are dealt to every fold that may see them, and a fold of a panel is one group.

A fold starts on a date. It learns from rows whose label was known before it (the label of a day reads the days after it)
and predicts the days up to the next fold's start. Rows between are features that are known, so filters run over them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import kernels as K

OUT = "panel string, fold int, date date, model string, p array<double>"


def folds(rows: DataFrame, starts: list[str], horizon: int = 5) -> DataFrame:
    """rows (panel, date, ...) with fold and part, once for each fold that may see them: 'train', 'gap' or 'test'.

    A row is 'train' if the `horizon`-th row after it, at which its label is complete, lies before the fold's start. Folds run
    from one start to the next, the last to the end. Rows with equal dates count as one day each. Fold numbers begin with 0.
    """
    known = F.lead("date", horizon).over(Window.partitionBy("panel").orderBy("date"))
    bounds = F.array(*(F.struct(F.lit(i).alias("fold"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for i, (a, b) in enumerate(zip(starts, [*starts[1:], None], strict=True))))
    dealt = rows.withColumn("_known", known).withColumn("_f", F.explode(bounds)).filter(F.col("_f.b").isNull() | (F.col("date") < F.col("_f.b")))
    part = F.when(F.col("date") >= F.col("_f.a"), "test").when(F.col("_known") < F.col("_f.a"), "train").otherwise("gap")
    return dealt.select(*rows.columns, F.col("_f.fold").alias("fold"), part.alias("part"))


def refitted(features: DataFrame, truth: DataFrame, columns: list[str], starts: list[str], model: str = "hmm", horizon: int = 5, rounds: int = 60, epochs: int = 60, seed: int = 42) -> DataFrame:
    """(panel, fold, date, model, p) of the test rows of each fold, of a model fitted on its train rows alone.

    model: `hmm`, a filter that reads no labels, or `network`, which learns the truth (panel, date, y). Rows with a null
    feature are left out; so are, of the train rows of a network, those without a label. A fold that may learn from fewer than
    30 rows gives uniform probabilities.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        train, test = (pdf["part"] == "train").to_numpy(), (pdf["part"] == "test").to_numpy()
        if model == "network":
            train &= pdf["y"].notna().to_numpy()
        x = pdf[columns].to_numpy(float)
        p = np.full((len(x), 5), 0.2)
        if train.sum() >= 30:
            z = (x - x[train].mean(0)) / (x[train].std(0) + 1e-8)
            if model == "hmm":
                p = K.hmm_proba(z, K.fit_hmm(z[train], rounds=rounds), True)
            else:
                net = K.Network(z.shape[1], seed + int(pdf["fold"].iloc[0]), (16,))
                net.fit(z[train], np.eye(5)[pdf["y"].to_numpy(float)[train].astype(int)], epochs=epochs)
                p = net.sample(z, 1).mean(0)
        out = pdf[test]
        return pd.DataFrame({"panel": out["panel"].to_numpy(), "fold": out["fold"].to_numpy(), "date": out["date"].to_numpy(), "model": f"{model}_refitted", "p": list(p[test])})

    rows = features.select("panel", "date", *columns).na.drop().join(truth.select("panel", "date", "y"), ["panel", "date"], "left")
    return folds(rows, starts, horizon).groupBy("panel", "fold").applyInPandas(run, OUT)
