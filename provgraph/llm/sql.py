"""DuckDB oracles of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from provgraph.llm.survivors import STAND_INS
from provgraph.plans.preparation_sql import TYPED, key, squeezed

_GROUPS = f"""ties AS (SELECT {key('id')} AS a, {key('merged_into_id')} AS b FROM objects),
 edges AS (SELECT DISTINCT a, b FROM ties WHERE a <> b UNION SELECT DISTINCT b, a FROM ties WHERE a <> b),
 reach AS (SELECT a AS id, a AS other FROM edges UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
 grp AS (SELECT id, min(other) AS group_id FROM reach GROUP BY 1)"""
_SOURCE = lambda c: key(f"replace({c}, '_', ' ')")
_STAND_INS = ", ".join(f"'{s}'" for s in STAND_INS)

ORACLE_SQL: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {_GROUPS} SELECT id, group_id FROM grp",
    "p1_group_sizes": f"""WITH RECURSIVE {_GROUPS}, s AS (SELECT group_id, count(*) AS n_objects FROM grp GROUP BY 1)
 SELECT n_objects, count(*) AS n_groups FROM s GROUP BY 1""",
    "p6_found": f"""WITH RECURSIVE {_GROUPS}, {TYPED},
 trust AS (SELECT {_SOURCE('source_system')} AS sk, min(trust_rank) AS rank FROM source_trust GROUP BY 1),
 usable AS (SELECT coalesce(grp.group_id, oid) AS gid, property, prop_row_id, trim(coalesce(verified_by, '')) <> '' AS ver, confidence, extracted_at, rank
  FROM typed LEFT JOIN grp ON grp.id = oid LEFT JOIN trust ON trust.sk = {_SOURCE('source_system')}
  WHERE state = 'ok' AND NOT is_multiple AND NOT (declared = 'STRING' AND lower({squeezed('txt')}) IN ({_STAND_INS}))),
 ranked AS (SELECT *, count(*) OVER (PARTITION BY gid, property) AS n, row_number() OVER (PARTITION BY gid, property
  ORDER BY ver DESC, confidence DESC NULLS LAST, extracted_at DESC NULLS LAST, rank NULLS LAST, prop_row_id) AS rn FROM usable)
 SELECT gid AS group_id, property AS property_name, prop_row_id FROM ranked WHERE rn = 1 AND n > 1""",
}
