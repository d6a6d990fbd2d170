"""All registered queries by name, and the DuckDB SQL that gives the same rows."""

from . import fact_plans, home_plans, join_plans, pricing_plans, session_plans, source_plans, stream_plans, text_plans

_ALL = [pricing_plans, session_plans, join_plans, text_plans, source_plans, stream_plans, home_plans, fact_plans]
QUERIES: dict = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE: dict = {k: v for m in _ALL for k, v in m.ORACLE.items()}
