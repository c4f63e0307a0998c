"""All registered queries and their SQL counterparts, gathered from the modules beside this one."""

from __future__ import annotations

from . import flow_queries, release_queries, rule_queries, span_queries, stream_queries, structure_queries, table_rule_queries, text_queries

MODULES = (text_queries, structure_queries, span_queries, flow_queries, stream_queries, rule_queries, release_queries, table_rule_queries)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}

#: Rules over typed fixtures, compared by the tests only.
CASES = {k: v for m in MODULES for k, v in getattr(m, "CASES", {}).items()}
CASE_SQL = {k: v for m in MODULES for k, v in getattr(m, "CASE_SQL", {}).items()}
