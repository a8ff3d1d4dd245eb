"""Invariants of predictions and uncertainties, checks of frames, and the chain of feature transformers."""

from __future__ import annotations

import importlib.util
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import simplex as S
from . import network, technical


def uncertainty_faults(total: Column, aleatoric: Column, epistemic: Column, tolerance: float = 1e-6) -> Column:
    """Names of the uncertainty measures that are missing or negative beyond the tolerance."""
    bad = {"total": total, "aleatoric": aleatoric, "epistemic": epistemic}
    return F.array_compact(F.array(*(F.when(c.isNull() | (c < -tolerance), name) for name, c in bad.items())))


def prediction_faults(p: Column, changepoint: Column, members: Column) -> Column:
    """Which of a prediction's invariants fail: probabilities on the simplex, a changepoint probability, a set with members."""
    return F.array_compact(F.array(
        F.when(~F.coalesce(S.is_simplex(p), F.lit(False)), "probabilities"), F.when(~F.coalesce(changepoint.between(0, 1), F.lit(False)), "changepoint"),
        F.when(F.coalesce(F.size(members), F.lit(0)) <= 0, "set"),
    ))


def unique_columns(df: DataFrame) -> DataFrame:
    """df with the first of columns of the same name."""
    names = df.columns
    numbered = df.toDF(*(f"_c{i}" for i in range(len(names))))
    first = {n: i for i, n in reversed(list(enumerate(names)))}
    return numbered.select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(names) if first[n] == i))


class Transformer(Protocol):
    """A step that turns a panel into features with the columns panel and date; fit() may learn from the panel."""

    def fit(self, panel: DataFrame) -> Transformer: ...

    def transform(self, panel: DataFrame) -> DataFrame: ...


class Stateless:
    """A transformer that learns nothing."""

    def __init__(self, function):
        self.function = function

    def fit(self, panel: DataFrame) -> Stateless:
        return self

    def transform(self, panel: DataFrame) -> DataFrame:
        return self.function(panel)


class FeaturePipeline:
    """Transformers that each get the original panel; their features are joined on panel and date, the first of equal names stays."""

    def __init__(self, steps: list[Transformer]):
        self.steps = steps

    def fit(self, panel: DataFrame) -> FeaturePipeline:
        return FeaturePipeline([s.fit(panel) for s in self.steps])

    def transform(self, panel: DataFrame) -> DataFrame:
        def joined(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.join(b.select("panel", "date", *(c for c in b.columns if c not in a.columns)), ["panel", "date"], "full")

        return reduce(joined, [s.transform(panel) for s in self.steps])


def required(panel: DataFrame, columns: tuple[str, ...] = ("panel", "date", "bench")) -> DataFrame:
    """panel, or an error while planning if a column that features need is missing."""
    missing = [c for c in columns if c not in panel.columns]
    if missing:
        raise ValueError(f"the panel lacks {', '.join(missing)}")
    return panel


def full_feature_matrix(panel: DataFrame) -> DataFrame:
    """Technical, topological and graph features side by side, for every date that any of them has."""
    steps = [Stateless(technical.technical_features), Stateless(network.topology_features), Stateless(network.graph_features)]
    return FeaturePipeline(steps).fit(required(panel)).transform(panel)


#: Adapters of embeddings: what each needs to be importable, and what it can do (fixed values).
ADAPTERS = [("context_projection", "numpy", "embedding"), ("patch_projection", "numpy", "embedding"), ("logistic_probe", "pyspark", "probabilities"), ("hosted_forecaster", "timesfm", "forecast"), ("pretrained_encoder", "chronos", "embedding")]


def capabilities(spark: SparkSession) -> DataFrame:
    """(adapter, capability, is_available, reason) of the adapters on this installation."""
    rows = [(name, what, found, "" if found else f"{module} isn't installed") for name, module, what in ADAPTERS for found in [importlib.util.find_spec(module) is not None]]
    return spark.createDataFrame(rows, "adapter string, capability string, is_available boolean, reason string")
