"""All queries of the core and their DuckDB oracles."""

from __future__ import annotations

from provgraph.plans import governance, governance_sql, graph, graph_sql, preparation, preparation_sql

QUERIES = {**graph.QUERIES, **governance.QUERIES, **preparation.QUERIES}
ORACLE_SQL = {**graph_sql.ORACLE_SQL, **governance_sql.ORACLE_SQL, **preparation_sql.ORACLE_SQL}
FLAGSHIP = graph.c1_supplier_device_risk_one
