"""Queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import records  # noqa: F401  registers its queries
from tidemark.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each kind; the whole list is compared by the driver.
CHOSEN = [
    "daily_bars", "quality_report", "series_availability", "asof_backward", "asof_nearest", "carried_panel", "snapshot_hashes", "technical_features", "recursive_features", "graph_adjacency", "graph_features", "variance_inflation",
    "forward_target", "tournament", "conformal_sets", "adaptive_conformal", "uncertainty", "model_disagreement", "regime_spells", "psi_report", "champion_registry", "allocation", "backtest_metrics",
    "crisis_episodes", "tail_risk", "scenario_parse", "scenario_grid", "response_claims", "feature_attribution", "stored_bars", "stored_scores", "series_contract", "frame_hash", "raw_quality", "index_quality",
    "top_drivers", "narratives", "backtest_lookup", "governance_lookup", "leak_free_features", "return_regression", "full_feature_matrix", "prediction_contracts", "score_ranking", "stacking_weights", "full_conviction", "deflated_sharpe", "audit_records", "committee_memos", "scenario_stress", "user_sessions", "late_events", "decayed_counts",
]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    rows = [tuple(float(v) + 0.0 if number(v) else v for v in r) for r in df.itertuples(index=False)]
    # keys (text and whole numbers) before measures, so that rows that differ in a last digit still meet
    whole = lambda v: not isinstance(v, float) or v != v or v == int(v)
    names = [i for i in range(len(df.columns)) if all(whole(r[i]) for r in rows)]
    return sorted(rows, key=lambda r: (repr([r[i] for i in names]), repr(r)))


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, sf, duck, name):
    ours, theirs = canonical(QUERIES[name](spark, sf).toPandas()), canonical(duck.execute(SQL[name]).df())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == pytest.approx(b, abs=2e-6)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
