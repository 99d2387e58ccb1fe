"""DuckDB oracles of the queries of records about the graph, over the same whole tables."""

from __future__ import annotations

from provgraph.model import OBJECT_TYPES
from provgraph.plans.graph_sql import _CHECKED, _CLEAN, _GRAPH, _LINK_RULES, _OBJECT_RULES, _RANKED, _RISK, _S, _confidence, _rules
from provgraph.plans.preparation_sql import TYPED, key

_LINKS = """dirty AS (SELECT * REPLACE (CAST(CASE WHEN x = '0' THEN 1.5 ELSE confidence END AS DECIMAL(4,3)) AS confidence, CASE WHEN x = '1' THEN 'GUESS' ELSE method END AS method,
 CASE WHEN x = '2' THEN 'anna' ELSE verified_by END AS verified_by, CASE WHEN x <> '3' THEN source_record_id END AS source_record_id, CASE WHEN x <> '4' THEN pipeline_run_id END AS pipeline_run_id,
 CASE WHEN x = '5' THEN from_id ELSE to_id END AS to_id, CASE WHEN x = '6' THEN 'KNOWS' ELSE link_type END AS link_type) FROM (SELECT *, right(trim(id), 1) AS x FROM links))"""
_OBJECTS = """dirty AS (SELECT * REPLACE (CASE WHEN x = '0' THEN id ELSE merged_into_id END AS merged_into_id, CASE WHEN x = '1' THEN created_at ELSE merged_at END AS merged_at,
 CASE WHEN x = '2' THEN 'PLANET' ELSE object_type END AS object_type) FROM (SELECT *, right(trim(id), 1) AS x FROM objects))"""
_AUDITS = """audits AS (SELECT 'A-' || o_orderkey AS id, CASE o_custkey % 5 WHEN 0 THEN 'AGENT' WHEN 1 THEN 'ROBOT' ELSE 'HUMAN' END AS actor_type,
 CASE o_orderkey % 5 WHEN 0 THEN 'PROPOSED' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'REJECTED' ELSE CASE WHEN o_orderkey % 5 = 4 AND o_custkey % 7 = 0 THEN 'DONE' ELSE 'EXECUTED' END END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN 'anna' END AS approved_by, CASE WHEN o_custkey % 4 <> 0 AND o_orderkey % 3 = 0 THEN o_orderdate END AS approved_at,
 CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'AGENT' WHEN 2 THEN 'CLERK' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'HUMAN' END END AS approver_type, o_orderdate AS proposed_at FROM orders)"""
_ADDRESSED = "addressed AS (SELECT DISTINCT 'A-' || l_orderkey AS audit_record_id, 'PART-' || l_partkey AS object_id FROM lineitem WHERE l_quantity > 25)"
_PROPOSALS = """proposals AS (SELECT 'P-' || o_orderkey AS id, 'S-' || (o_custkey % 50) AS survivor_id, 'S-' || (o_orderkey % 70) AS duplicate_id, (o_orderkey % 1300) / 1000 AS score,
 CASE o_orderkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'REJECTED' ELSE 'OPEN' END AS status, CASE WHEN o_custkey % 3 = 0 THEN o_orderdate END AS resolved_at,
 CASE WHEN o_custkey % 9 = 0 THEN 'A-' || o_orderkey END AS resolution_audit_id FROM orders)"""
_RUNS = """runs AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'run-' || o_orderkey END AS id, o_orderdate AS started_at,
 CASE o_custkey % 3 WHEN 1 THEN o_orderdate - INTERVAL 1 DAY WHEN 2 THEN o_orderdate + INTERVAL 1 DAY END AS finished_at FROM orders)"""
_VERSIONS = """versions AS (SELECT n_name AS version, CASE n_nationkey % 4 WHEN 0 THEN '[1]' WHEN 1 THEN '{}' WHEN 2 THEN '[broken' ELSE '[]' END AS object_types, CASE WHEN n_nationkey % 5 <> 0 THEN '[]' END AS link_types,
 CASE n_nationkey % 3 WHEN 0 THEN 'MIGRATION' WHEN 1 THEN 'AGENT_PROPOSAL' ELSE 'HAND' END AS applied_via, CASE WHEN n_nationkey % 2 = 0 THEN 'A-1' END AS audit_record_id FROM nation)"""
_AUDIT_RULES = {
    "L12_approval_pair": "(approved_by IS NULL) <> (approved_at IS NULL)",
    "L12_approver_without_approval": "approved_by IS NOT NULL AND status NOT IN ('APPROVED', 'EXECUTED')",
    "L12_approved_by_nobody": "status = 'APPROVED' AND approved_by IS NULL",
    "L13_agent_executed_alone": "actor_type = 'AGENT' AND status = 'EXECUTED' AND approved_by IS NULL",
    "L13_approver_type_pair": "(approved_by IS NULL) <> (approver_type IS NULL)",
    "L13_approver_is_no_human": "approved_by IS NOT NULL AND coalesce(approver_type, '') <> 'HUMAN'",
    "L13_approver_type": "approver_type NOT IN ('HUMAN', 'AGENT')",
    "L19_actor_type": "actor_type NOT IN ('HUMAN', 'AGENT')",
    "L19_audit_status": "status NOT IN ('PROPOSED', 'APPROVED', 'REJECTED', 'EXECUTED')",
}
_array = lambda c: f"CASE WHEN json_valid({c}) THEN json_type({c}) <> 'ARRAY' ELSE true END"
_VERSION_RULES = {
    "L14_agent_change_unaudited": "applied_via <> 'MIGRATION' AND audit_record_id IS NULL",
    "L14_object_types_no_array": _array("object_types"),
    "L14_link_types_no_array": f"link_types IS NULL OR {_array('link_types')}",
    "L19_applied_via": "applied_via NOT IN ('MIGRATION', 'AGENT_PROPOSAL')",
}
_PROPOSAL_RULES = {
    "L1_score_range": "score > 1",
    "L16_merged_with_itself": "survivor_id = duplicate_id",
    "L16_status": "status = 'OPEN'",
    "L16_resolved_pair": "(status = 'PENDING' AND (resolved_at IS NOT NULL OR resolution_audit_id IS NOT NULL)) OR (status IN ('CONFIRMED', 'REJECTED') AND resolved_at IS NULL)",
}
_RUN_RULES = {"L17_run_id": "id = ''", "L17_finished_before_start": "finished_at < started_at"}
_count = lambda table, rules: f"SELECT rule, count(*) AS n_rows FROM ({_rules(table, 'id', rules)}) GROUP BY 1"
_REGISTRY = "registry(object_type, property_name, declared, multiple) AS (VALUES {})".format(
    ", ".join(f"('{t.name}','{p.name}','{p.value_type}',{str(p.multiple).lower()})" for t in OBJECT_TYPES.values() for p in t.properties)
)
_BREAKS = " ".join(
    f"WHEN object_type = '{t.name}' AND property = '{p.name}' AND " + (
        f"txt NOT IN ({', '.join(repr(v) for v in p.enum)}) THEN 'not in the closed list'" if p.enum
        else f"num < {p.minimum} THEN 'below the minimum'" if p.minimum is not None else "txt = '' THEN 'empty'"
    )
    for t in OBJECT_TYPES.values() for p in t.properties if p.enum or p.minimum is not None or p.value_type == "STRING"
)
# Field, its table, column and row condition, and the values it may have.
_REFERENCES = [
    ("object_properties.object_id", "object_properties", "object_id", "SELECT id FROM objects"), ("links.from_id", "links", "from_id", "SELECT id FROM objects"),
    ("links.to_id", "links", "to_id", "SELECT id FROM objects"), ("objects.schema_version", "objects", "schema_version", "SELECT '0.1.0'"),
    ("objects.merged_into_id", "objects", "merged_into_id", "SELECT id FROM objects"), ("object_source_keys.object_id", "object_properties", "object_id", "SELECT id FROM objects"),
    ("merge_proposals.survivor_id", "objects", "merged_into_id", "SELECT id FROM objects"), ("audit_records.schema_version", "(SELECT '9.9.9' AS v FROM audits)", "v", "SELECT '0.1.0'"),
    ("audit_record_objects.audit_record_id", "addressed", "audit_record_id", "SELECT id FROM audits"), ("audit_record_objects.object_id", "addressed", "object_id", "SELECT id FROM objects"),
    ("ingestion_runs.audit_record_id", "(SELECT 'A-' || substr(id, 5, 2) AS v FROM runs)", "v", "SELECT id FROM audits"), ("schema_versions.audit_record_id", "(SELECT 'A-1' AS v)", "v", "SELECT id FROM audits"),
]
_missing = lambda f, t, c, to: f"SELECT '{f}' AS field, count(*) AS n_rows, count(DISTINCT {c}) AS n_targets FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT * FROM ({to}) AS q(w) WHERE w IS NOT NULL) HAVING count(*) > 0"

ORACLE_SQL: dict[str, str] = {
    "l_planted_links": f"WITH {_LINKS} {_count('dirty', _LINK_RULES)}",
    "l_planted_objects": f"WITH {_OBJECTS} {_count('dirty', _OBJECT_RULES)}",
    "l11_planted_end_types": f"""WITH {_LINKS}, types AS (SELECT {key('id')} AS k, min(object_type) AS t FROM objects GROUP BY 1)
 SELECT l.id, l.link_type, a.t AS from_type, b.t AS to_type FROM dirty l JOIN types a ON a.k = {key('l.from_id')} JOIN types b ON b.k = {key('l.to_id')}
 WHERE (l.link_type, a.t, b.t) NOT IN (('SUPPLIES','SUPPLIER','PART'),('COMPOSED_OF','DEVICE','PART'),('MANUFACTURED_AT','DEVICE','SITE'),
 ('AFFECTS_SUPPLIER','QUALITY_EVENT','SUPPLIER'),('AFFECTS_PART','QUALITY_EVENT','PART'))""",
    "l12_audit_violations": f"WITH {_AUDITS} {_rules('audits', 'id', _AUDIT_RULES)}",
    "l14_schema_violations": f"WITH {_VERSIONS} {_rules('versions', 'version', _VERSION_RULES)}",
    "l16_proposal_violations": f"WITH {_PROPOSALS} {_rules('proposals', 'id', _PROPOSAL_RULES)}",
    "l16_pending_twice": f"WITH {_PROPOSALS} SELECT duplicate_id, count(*) AS n_rows FROM proposals WHERE status = 'PENDING' GROUP BY 1 HAVING count(*) > 1",
    "l17_run_violations": f"WITH {_RUNS} {_count('runs', _RUN_RULES)}",
    "l19_source_keys": f"""SELECT CAST(line_no AS VARCHAR) AS row_key, 'L19_source_system' AS rule FROM vendor_master WHERE line_no % 9 = 0
 UNION ALL SELECT CAST(line_no AS VARCHAR), 'L19_source_key' FROM vendor_master WHERE {_S('LIFNR')} = ''""",
    "l11_all_references": f"WITH {_AUDITS}, {_ADDRESSED}, {_RUNS} {' UNION ALL '.join(_missing(*r) for r in _REFERENCES)}",
    "l18_unaddressed_audits": f"WITH {_AUDITS}, {_ADDRESSED} SELECT id FROM audits WHERE id NOT IN (SELECT audit_record_id FROM addressed)",
    "l18_declared_types": f"""WITH {_REGISTRY}, types AS (SELECT {key('id')} AS k, min(object_type) AS object_type FROM objects GROUP BY 1),
 j AS (SELECT p.property_name, p.value_type, CASE WHEN declared IS NULL THEN 'not declared' WHEN declared IS DISTINCT FROM p.value_type THEN 'another value type' END AS problem
  FROM object_properties p JOIN types ON types.k = {key('p.object_id')} LEFT JOIN registry r ON r.object_type = types.object_type AND r.property_name = p.property_name)
 SELECT property_name, value_type, problem, count(*) AS n_rows FROM j WHERE problem IS NOT NULL GROUP BY 1, 2, 3""",
    "b21_value_breaks": f"""WITH {TYPED}, b AS (SELECT prop_row_id, object_type, property, CASE {_BREAKS} END AS problem FROM typed WHERE state = 'ok')
 SELECT * FROM b WHERE problem IS NOT NULL""",
    "b15_pending_approvals": f"WITH {_AUDITS} SELECT id, actor_type, proposed_at FROM audits WHERE status = 'PROPOSED'",
    "b2_property_rows_of_one": """WITH most AS (SELECT object_id FROM object_properties GROUP BY 1 ORDER BY count(*) DESC, object_id LIMIT 1)
 SELECT object_id, property_name, ordinal, value, confidence, prop_row_id FROM object_properties WHERE object_id = (SELECT object_id FROM most)""",
    "c2_audit_history": f"WITH {_AUDITS}, {_ADDRESSED} SELECT id, status, proposed_at FROM audits WHERE id IN (SELECT audit_record_id FROM addressed WHERE object_id = 'PART-1')",
    "d7_upsert_keeps_verification": """WITH r AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS run FROM lineitem),
 s AS (SELECT l_suppkey AS from_id, l_partkey % 25 AS to_id, CAST(round(0.4 + l_discount, 3) AS DECIMAL(4,3)) AS confidence, 'run-' || run || ':' || l_orderkey || ':' || l_linenumber AS source_record_id,
  CASE WHEN run = 0 AND l_orderkey % 3 = 0 THEN 'anna' END AS verified_by, CAST(l_orderkey AS BIGINT) * 8 + l_linenumber + run * 1125899906842624 AS seq FROM r)
 SELECT 'SUPPLIES' AS link_type, from_id, to_id, min(confidence) AS confidence, max(seq) AS seq, arg_max(source_record_id, seq) AS source_record_id,
  arg_min(struct_pack(v := verified_by), seq).v AS verified_by FROM s GROUP BY 2, 3""",
    "k11_updated_values": """WITH f AS (SELECT object_id, property_name, ordinal, arg_min(struct_pack(value := value, confidence := confidence, method := method, source_system := source_system,
  source_record_id := source_record_id, pipeline_run_id := pipeline_run_id, extracted_at := extracted_at), prop_row_id) AS r FROM object_properties WHERE property_name IN (SELECT property_name FROM property_catalog) AND value IS NOT NULL GROUP BY 1, 2, 3),
 g AS (SELECT *, property_name IN ('deviceName', 'status') AND ordinal = 0 AS hit FROM f)
 SELECT object_id, property_name, ordinal, CASE WHEN hit THEN '"new ' || property_name || '"' ELSE r.value END AS value, CASE WHEN hit THEN CAST(1 AS DECIMAL(4,3)) ELSE r.confidence END AS confidence,
  CASE WHEN hit THEN 'HUMAN_ENTRY' ELSE r.method END AS method, CASE WHEN hit THEN 'ACTION' ELSE r.source_system END AS source_system, CASE WHEN hit THEN 'audit-1' ELSE r.source_record_id END AS source_record_id,
  CASE WHEN NOT hit THEN r.pipeline_run_id END AS pipeline_run_id, CASE WHEN hit THEN TIMESTAMPTZ '2026-01-15 09:30:00+00' ELSE r.extracted_at END AS extracted_at FROM g""",
    "k10_states": f"""WITH {_CLEAN} SELECT object_id, '{{' || string_agg('"' || property_name || '":' || value, ',' ORDER BY property_name) || '}}' AS before,
 '{{' || string_agg('"' || property_name || '":"new ' || property_name || '"', ',' ORDER BY property_name) || '}}' AS after FROM clean WHERE property_name IN ('deviceName', 'status') AND ordinal = 0 GROUP BY 1""",
    "h3_countries": r"SELECT upper(trim(regexp_replace(LAND1, '\s+', ' ', 'g'))) AS country, count(*) AS n_rows FROM vendor_master GROUP BY 1",
    "h13_canonical_results": f"""{_GRAPH}, {_RISK}, {_RANKED.format(where=" WHERE src = 'SUP-0'")}
 SELECT src AS source_id, dst AS target_id, '{{"profile":"SUPPLIER_DEVICE_RISK","target":"' || dst || '","confidence":' || c || ',"path_count":' || n || ',"best_path":{{"from":"' || src || '","weakest_step_index":' ||
  CASE WHEN c1 = c THEN 0 ELSE 1 END || ',"steps":[{{"link_type":"SUPPLIES","direction":"ALONG","confidence":' || c1 || ',"to":"' || mid || '"}},{{"link_type":"COMPOSED_OF","direction":"AGAINST","confidence":' || c2 || ',"to":"' || dst || '"}}]}}}}' AS result
 FROM ranked WHERE rn = 1""",
    "i_streamed_upserts": """WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS from_id, CAST(l_partkey % 25 AS VARCHAR) AS to_id, CAST(round(0.4 + l_discount, 3) AS DECIMAL(4,3)) AS confidence, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS run FROM lineitem)
 SELECT from_id, to_id, min(confidence) AS confidence, 'run-' || max(run) AS source_record_id, CASE WHEN min(run) = 0 THEN 'anna' END AS verified_by FROM s GROUP BY 1, 2""",
    "i_windows": """SELECT time_bucket(INTERVAL 7 DAYS, created_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS start, link_type, count(*) AS n_links, min(confidence) AS least_confidence FROM links WHERE created_at IS NOT NULL GROUP BY 1, 2""",
    "a6_csv_round_trip": "SELECT {}, true AS numbered FROM vendor_master".format(", ".join(f"coalesce({c}, '') AS {c}" for c in ("LIFNR", "NAME1", "LAND1", "TIER", "DUNS", "QUALITY_RATING", "CERTIFICATIONS"))),
    "a9_ingested_twice": f"""WITH {_CHECKED}, o AS (SELECT 'v' AS t, {_S('LIFNR')} AS k, arg_min(struct_pack(d := nullif({_S('DUNS')}, '') IS NOT NULL, n := 5,
   c := len(list_filter(string_split(coalesce(CERTIFICATIONS, ''), '|'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''))), line_no) AS r FROM v WHERE code IS NULL GROUP BY 2
  UNION ALL SELECT 'm', {_S('MATNR')}, struct_pack(d := false, n := 6, c := 0) FROM m WHERE code IS NULL GROUP BY 2 UNION ALL SELECT 'd', {_S('DEVICE_ID')}, struct_pack(d := false, n := 4, c := 0) FROM d WHERE code IS NULL GROUP BY 2),
 l AS (SELECT 'S' AS t, {_S('LIFNR')} AS a, {_S('MATNR')} AS b, {_confidence('CONFIDENCE', 0.9)} AS c FROM s WHERE code IS NULL UNION ALL SELECT 'B', {_S('DEVICE_ID')}, {_S('MATNR')}, {_confidence('CONFIDENCE', 0.85)} FROM b WHERE code IS NULL),
 e AS (SELECT least(min(c), 0.45) AS c FROM l GROUP BY t, a, b)
 SELECT 'objects' AS table_name, count(*) AS n_rows, CAST(NULL AS DECIMAL(4,3)) AS most_confidence FROM o UNION ALL SELECT 'object_source_keys', count(*), NULL FROM o
 UNION ALL SELECT 'object_properties', CAST(sum(r.n + CAST(r.d AS INT) + r.c) AS BIGINT), 1 FROM o UNION ALL SELECT 'links', count(*), max(c) FROM e
 UNION ALL SELECT 'audit_records', 2, NULL UNION ALL SELECT 'audit_record_objects', 2 * count(*), NULL FROM o UNION ALL SELECT 'ingestion_runs', 2, NULL""",
    "m1_registry": f"""WITH {_REGISTRY} SELECT coalesce(r.object_type, c.object_type) AS object_type, coalesce(r.property_name, c.property_name) AS property_name, coalesce(r.declared, c.value_type) AS value_type,
 coalesce(r.multiple, c.is_multiple) AS is_multiple, r.object_type IS NOT NULL AS declared, c.object_type IS NOT NULL AS given
 FROM registry r FULL JOIN property_catalog c ON c.object_type = r.object_type AND c.property_name = r.property_name AND c.value_type = r.declared AND c.is_multiple = r.multiple""",
}
