"""DuckDB oracles of the data-preparation queries, over the same whole tables."""

from __future__ import annotations

_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'), ' ')"


def key(c: str) -> str:
    return f"nullif(lower({squeezed(c)}), '')"


def number_key(c: str) -> str:
    return rf"regexp_replace({key(c)}, '^0+(.)', '\1')"


def name_key(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\pL\p{{Nd}}]', '', 'g')"


NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_NOT_NEGATIVE = r"(?:\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)|-(?:0+\.?0*|\.0+))(?:[eE][+-]?[0-9]+)?"

_FAILING = f"""parents AS (
  SELECT 'vendor' AS t, {number_key('LIFNR')} AS k, loaded_at AS seen, deleted_at AS gone FROM vendor_master
  UNION ALL SELECT 'material', {key('MATNR')}, loaded_at, deleted_at FROM material_master
  UNION ALL SELECT 'device', {key('DEVICE_ID')}, loaded_at, deleted_at FROM device_master
  UNION ALL SELECT 'object', {key('id')}, created_at, NULL FROM objects),
 p AS (SELECT t, k, min(seen) AS first_seen, bool_and(gone IS NOT NULL) AS all_gone, max(gone) AS last_gone FROM parents GROUP BY 1, 2),
 refs AS (
  SELECT 'supply_relationship' AS src_table, 'LIFNR' AS ref_field, 'vendor' AS t, {number_key('LIFNR')} AS k, CAST(line_no AS VARCHAR) AS row_key, loaded_at AS ref_at FROM supply_relationship
  UNION ALL SELECT 'supply_relationship', 'MATNR', 'material', {key('MATNR')}, CAST(line_no AS VARCHAR), loaded_at FROM supply_relationship
  UNION ALL SELECT 'device_bom', 'DEVICE_ID', 'device', {key('DEVICE_ID')}, CAST(line_no AS VARCHAR), loaded_at FROM device_bom
  UNION ALL SELECT 'links', 'to_id', 'object', {key('to_id')}, id, created_at FROM links),
 failing AS (SELECT src_table, ref_field, row_key, strftime(ref_at, '%Y-%m') AS period,
  CASE WHEN p.t IS NULL THEN 'missing' WHEN first_seen > ref_at THEN 'late' WHEN all_gone AND last_gone <= ref_at THEN 'deleted' END AS status
  FROM refs LEFT JOIN p ON p.t = refs.t AND p.k = refs.k WHERE refs.k IS NOT NULL)"""

_FIELD = r"""(?:"[^"]*(?:""[^"]*)*"|[^",]*)"""
_SOUND = rf"(?s){_FIELD}(?:,{_FIELD})*"


def _reasons(table: str, name: str, n: int, checks: dict[int, tuple[str, str]]) -> str:
    """One SELECT per reason; checks: field number -> (regex of the valid unquoted value, reason)."""
    exactly = "(?s)" + ",".join([_FIELD] * n)
    groups = "(?s)" + ",".join([f"({_FIELD})"] * n)
    base = f"SELECT '{name}' AS src_table, line_no"
    row = "coalesce(raw_line, '')"
    sound, count = f"regexp_full_match({row}, '{_SOUND}')", f"regexp_full_match({row}, '{exactly}')"
    parts = [
        f"{base}, 'quoting' AS reason FROM {table} WHERE NOT {sound}",
        f"{base}, 'column_count' FROM {table} WHERE {sound} AND NOT {count}",
    ]
    for field, (valid, reason) in checks.items():
        raw = f"regexp_extract({row}, '^{groups}$', {field})".replace("^(?s)", "(?s)^")
        value = f"""CASE WHEN starts_with({raw}, '"') THEN replace(substr({raw}, 2, length({raw}) - 2), '""', '"') ELSE {raw} END"""
        parts.append(f"{base}, '{reason}' FROM {table} WHERE {count} AND NOT regexp_full_match({value}, '{valid}')")
    return " UNION ALL ".join(parts)


_PAD = f"{_WS}*"
_P4 = " UNION ALL ".join(
    [
        _reasons("vendor_raw", "vendor_master", 7, {6: (f"{_PAD}{NUMBER}{_PAD}", "invalid_quality_rating")}),
        _reasons("material_raw", "material_master", 5, {
            1: (r"(?s).*[\pL\p{Nd}].*", "invalid_matnr"),
            3: (f"(?i){_PAD}(?:DIRECT_MATERIAL|COMPONENT|SUBASSEMBLY){_PAD}", "invalid_class"),
            5: (f"{_PAD}{_NOT_NEGATIVE}{_PAD}", "invalid_unit_cost"),
        }),
    ]
)


def _first_prefix(n: int) -> str:
    """The first k for which the row doesn't begin with k sound fields; n + 1 if there is none."""
    cases = [f"WHEN NOT regexp_matches(coalesce(raw_line, ''), '(?s)^{','.join([_FIELD] * k)}(?:,|$)') THEN {k}" for k in range(1, n + 1)]
    return f"CASE {' '.join(cases)} ELSE {n + 1} END"


_FIRST_BROKEN = f"""WITH p4 AS ({_P4}),
 broken AS (SELECT 'vendor_master' AS src_table, line_no, {_first_prefix(7)} AS k FROM vendor_raw UNION ALL SELECT 'material_master', line_no, {_first_prefix(5)} FROM material_raw),
 places AS (SELECT p4.src_table, reason, CAST(CASE WHEN reason IN ('quoting', 'column_count') THEN k ELSE min(CASE reason WHEN 'invalid_matnr' THEN 1 WHEN 'invalid_class' THEN 3
  WHEN 'invalid_unit_cost' THEN 5 WHEN 'invalid_quality_rating' THEN 6 END) OVER (PARTITION BY p4.src_table, p4.line_no) END AS INT) AS broken_field FROM p4 JOIN broken USING (src_table, line_no))
 SELECT src_table, reason, broken_field, count(*) AS n_rows FROM places GROUP BY 1, 2, 3"""


def _loaded(raw: str, master: str, columns: str) -> str:
    bad = f"SELECT line_no FROM ({_P4}) WHERE src_table = '{master}'"
    return f"SELECT line_no, {columns} FROM {master} WHERE line_no NOT IN ({bad})"


_STRING = r"""[ \t\r\n]*"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"[ \t\r\n]*"""
_JSON_NUMBER = r"[ \t\r\n]*-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?[ \t\r\n]*"
_STAMP = r"([0-9]{4}-?[0-9]{2}-?[0-9]{2})T(?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?(?:[0-5][0-9]|60)(?:[.,][0-9]+)?)?)?(?:Z|z|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9])?)"
TYPED = f"""types AS (SELECT {key('id')} AS oid, min(object_type) AS object_type FROM objects GROUP BY 1),
 cat AS (SELECT object_type, {name_key('property_name')} AS nk, property_name AS property, value_type AS declared, is_multiple FROM property_catalog),
 r0 AS (SELECT p.prop_row_id, types.oid, types.object_type, cat.property, cat.declared, cat.is_multiple, p.ordinal, p.value, p.confidence, p.source_system, p.extracted_at, p.verified_by,
  CASE WHEN regexp_full_match(value, '{_STRING}') THEN 'string' WHEN regexp_full_match(value, '{_JSON_NUMBER}') THEN 'number'
   WHEN regexp_full_match(value, '[ \\t\\r\\n]*(?:true|false)[ \\t\\r\\n]*') THEN 'boolean' WHEN regexp_full_match(value, '[ \\t\\r\\n]*null[ \\t\\r\\n]*') THEN 'null' ELSE 'other' END AS kind
  FROM object_properties p JOIN types ON types.oid = {key('p.object_id')} JOIN cat ON cat.object_type = types.object_type AND cat.nk = {name_key('p.property_name')}),
 r1 AS (SELECT *, CASE kind WHEN 'string' THEN json_extract_string(value, '$') WHEN 'number' THEN regexp_replace(value, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')
  WHEN 'boolean' THEN regexp_replace(value, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') END AS txt FROM r0),
 r2 AS (SELECT *, {squeezed('txt')} AS tt FROM r1),
 r3 AS (SELECT *, CASE WHEN declared = 'NUMBER' AND kind IN ('string', 'number') AND regexp_full_match(tt, '{NUMBER}') THEN TRY_CAST(tt AS DOUBLE) END AS num,
  CASE WHEN declared = 'BOOLEAN' AND kind IN ('string', 'boolean') AND lower(tt) IN ('true', 'false') THEN lower(tt) = 'true' END AS flag,
  CASE WHEN declared = 'TIMESTAMP' AND kind = 'string' AND regexp_full_match(tt, '{_STAMP}') AND TRY_CAST(regexp_extract(tt, '{_STAMP}', 1) AS DATE) IS NOT NULL
   THEN TRY_CAST(tt AS TIMESTAMPTZ) END AS stamp FROM r2),
 typed AS (SELECT *, CASE WHEN value IS NULL OR kind = 'null' OR (kind = 'string' AND tt = '') THEN 'empty'
  WHEN CASE declared WHEN 'STRING' THEN kind IN ('string', 'number', 'boolean') WHEN 'NUMBER' THEN kind IN ('string', 'number') AND regexp_full_match(tt, '{NUMBER}')
   WHEN 'BOOLEAN' THEN flag IS NOT NULL WHEN 'TIMESTAMP' THEN stamp IS NOT NULL ELSE false END THEN 'ok' ELSE 'unreadable' END AS state FROM r3)"""

# The declared properties, with the column that holds their type and whether they are lists.
_WIDE = {
    "aliases": ("txt", True), "certifications": ("txt", True), "classification": ("txt", False), "closedAt": ("stamp", False),
    "country": ("txt", False), "criticality": ("txt", False), "description": ("txt", False), "deviceName": ("txt", False),
    "duns": ("txt", False), "eventType": ("txt", False), "legalName": ("txt", False), "lifecycleStage": ("txt", False),
    "mergedFrom": ("txt", True), "openedAt": ("stamp", False), "partNumber": ("txt", False), "productFamily": ("txt", False),
    "qualityRating": ("num", False), "regulatoryClass": ("txt", False), "requiresRequalification": ("flag", False),
    "severity": ("txt", False), "siteName": ("txt", False), "siteType": ("txt", False), "status": ("txt", False),
    "tier": ("txt", False), "unitCost": ("num", False),
}


def _wide_column(name: str, value: str, multiple: bool) -> str:
    mine = f"FILTER (property = '{name}')"
    if multiple:
        return f"CAST(to_json(list({value} ORDER BY ordinal, prop_row_id) {mine}) AS VARCHAR) AS \"{name}\""
    return f'arg_min({value}, struct_pack(o := ordinal, p := prop_row_id)) {mine} AS "{name}"'


# Quoted spans are kept, separators elsewhere become one control character, which is split at.
_CERTS = r"""p0 AS (SELECT line_no, regexp_replace(regexp_replace(trim(CERTIFICATIONS, E' \t\r\n'), '^[/+]', ''), '[/+]$', '') AS c FROM vendor_master WHERE CERTIFICATIONS IS NOT NULL),
 p1 AS (SELECT line_no, CASE WHEN c LIKE '[%]' THEN from_json(c, '["VARCHAR"]') ELSE list_transform(string_split(array_to_string(list_transform(
   regexp_extract_all(c, '"[^"]*(?:""[^"]*)*"|''[^'']*(?:''''[^'']*)*''|[^"'']+|["'']'),
   lambda x: CASE WHEN length(x) > 1 AND x[1] IN ('"', '''') THEN x ELSE regexp_replace(x, '[|;,\t\r\n]|\s+[/+](?:\s+[/+])*\s+|\s[/+]$|^[/+]\s', chr(1), 'g') END), ''), chr(1)),
   lambda x: CASE WHEN trim(x) LIKE '"%"' THEN replace(trim(x)[2:-2], '""', '"') WHEN trim(x) LIKE '''%''' THEN replace(trim(x)[2:-2], '''''', '''') ELSE x END) END AS l FROM p0),
 p2 AS (SELECT line_no, list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM p1),
 certs AS (SELECT line_no, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS cert FROM p2)"""

ORACLE_SQL: dict[str, str] = {
    "p5_found": f"WITH {_CERTS} SELECT line_no, pos, cert FROM certs",
    "p5_per_certificate": f"WITH {_CERTS} SELECT cert, count(*) AS n_rows, max(pos) AS max_pos FROM certs GROUP BY 1",
    "p3_found": f"WITH {_FAILING} SELECT src_table, ref_field, row_key, status, period FROM failing WHERE status IS NOT NULL",
    "p3_by_month": f"WITH {_FAILING} SELECT src_table, ref_field, status, period, count(*) AS n_failing FROM failing WHERE status IS NOT NULL GROUP BY ALL",
    "p4_found": _P4,
    "p4_first_broken_field": _FIRST_BROKEN,
    "p4_loaded_vendors": _loaded("vendor_raw", "vendor_master", "LIFNR, NAME1, LAND1, TIER, DUNS, QUALITY_RATING, CERTIFICATIONS"),
    "p4_loaded_materials": _loaded("material_raw", "material_master", "MATNR, MAKTX, CLASS, CRITICALITY, UNIT_COST"),
    "p7_found": f"WITH {TYPED} SELECT prop_row_id FROM typed WHERE state = 'unreadable'",
    "p7_wide": f"""WITH {TYPED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY oid, property, ordinal
  ORDER BY coalesce(confidence, -1) DESC, extracted_at DESC NULLS LAST, prop_row_id) AS rn FROM typed WHERE state = 'ok'),
 best AS (SELECT * FROM ranked WHERE rn = 1), ids AS (SELECT DISTINCT {key('id')} AS object_id FROM objects)
 SELECT object_id, {", ".join(_wide_column(n, *v) for n, v in _WIDE.items())} FROM ids LEFT JOIN best ON best.oid = ids.object_id WHERE object_id IS NOT NULL GROUP BY object_id""",
}
