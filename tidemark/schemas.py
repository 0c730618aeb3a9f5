"""Schemas of the stored tables, and additive evolution towards them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _schema(ddl: str) -> dict[str, str]:
    return dict(f.split(" ", 1) for f in ddl.split(", "))


#: Column types by table and name.
SCHEMAS: dict[str, dict[str, str]] = {
    "headlines": _schema(
        "id long, source string, title string, url string, published_date date, published_ts timestamp_ntz, category string, "
        "sentiment_score double, sentiment_label string, relevance double, model_name string, experiment_id string, processing_status string, "
        "attempts int, signal_date date, timing_bucket string, session_rule_version string, signal_family string, signal_family_ambiguous int, is_market_recap int"
    ),
    "observations": _schema("observation_key string, headline_id long, source string, url string, title string, published_date date, observed_ts timestamp_ntz, payload string"),
    "exclusions": _schema("headline_id long, reason string, rule_version string, excluded_by string, excluded_at timestamp_ntz, restored_by string, restored_at timestamp_ntz"),
    "bars": _schema("date date, open double, high double, low double, close double, volume long, daily_return double, bar_status string"),
    "factors": _schema("date date, symbol string, close double, daily_return double"),
    "external_series": _schema("date date, series string, value double"),
    "event_groups": _schema("group_key string, algorithm_version string, signal_family string, first_seen timestamp_ntz, last_seen timestamp_ntz, headline_count long, source_count long, mean_sentiment double"),
    "event_headline_map": _schema("group_key string, algorithm_version string, headline_id long, similarity double"),
    "return_windows": _schema("group_key string, window_name string, entry_date date, exit_date date, raw_return double, is_available int, is_tradable int, reason string"),
    "residual_returns": _schema("exit_date date, window_name string, control_set string, raw_return double, fitted double, residual double, n_train long, method_version string"),
    "session_units": _schema("session date, window_name string, dataset_version string, target double, features map<string,double>"),
    "pipeline_runs": _schema("run_id string, started_at timestamp_ntz, ended_at timestamp_ntz, status string, outcomes string"),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the table's columns: missing ones null, others dropped, all cast."""
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in SCHEMAS[table].items()])


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
