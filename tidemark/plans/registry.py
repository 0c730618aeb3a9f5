"""All registered queries of the library."""

from __future__ import annotations

from tidemark.plans import ingest_plans, market_plans, model_plans, provenance_plans, report_plans, signal_plans, study_plans, text_plans

MODULES = (signal_plans, market_plans, text_plans, report_plans, model_plans, study_plans, provenance_plans, ingest_plans)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
