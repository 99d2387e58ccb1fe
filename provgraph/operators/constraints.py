"""Integrity rules as violation queries: each returns the offending rows, empty if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.functions.skew import hot_keys, salted_join
from provgraph.functions.text import is_blank, key
from provgraph.model import ACTOR_TYPES, APPLIED_VIA, AUDIT_STATUS, LINK_TYPES, METHODS, OBJECT_TYPES, PROPOSAL_STATUS, VALUE_TYPES
from provgraph.operators.property_table import json_kind

PROPERTY_KEY = ["object_id", "property_name", "ordinal"]

_KIND_OF = {"STRING": "string", "NUMBER": "number", "BOOLEAN": "boolean", "TIMESTAMP": "string"}


def evidence_rules() -> dict[str, Column]:
    """Row rules that properties and links share; true means violated."""
    c = F.col
    null_as = lambda x: F.coalesce(x, F.lit(False))
    return {
        "L1_confidence_range": ~F.coalesce(c("confidence").between(0, 1), F.lit(False)),
        "L2_method": ~null_as(c("method").isin(*METHODS)),
        "L4_verified_is_certain": ~is_blank(c("verified_by")) & ~null_as(c("confidence") == 1),
        "L5_verification_pair": c("verified_by").isNull() != c("verified_at").isNull(),
        "L8_record_unless_inferred": c("source_record_id").isNull() != null_as(c("method") == "INFERRED"),
        "L9_run_unless_human": c("pipeline_run_id").isNull() != null_as(c("method") == "HUMAN_ENTRY"),
    }


def property_rules() -> dict[str, Column]:
    wanted = reduce(lambda e, kv: F.when(F.col("value_type") == kv[0], F.lit(kv[1])).otherwise(e), _KIND_OF.items(), F.lit("none"))
    return evidence_rules() | {
        "L3_value_type": ~F.coalesce(F.col("value_type").isin(*VALUE_TYPES), F.lit(False)) | (F.coalesce(json_kind(F.col("value")), F.lit("none")) != wanted),
        "L7_property_key": is_blank(F.col("object_id")) | is_blank(F.col("property_name")) | F.coalesce(F.col("ordinal") < 0, F.lit(True)),
    }


def link_rules() -> dict[str, Column]:
    return evidence_rules() | {
        "L6_self_link": F.col("from_id") == F.col("to_id"),
        "L19_link_type": ~F.coalesce(F.col("link_type").isin(*LINK_TYPES), F.lit(False)),
    }


def object_rules() -> dict[str, Column]:
    return {
        "L15_merged_into_itself": F.col("merged_into_id") == F.col("id"),
        "L15_merge_pair": F.col("merged_into_id").isNull() != F.col("merged_at").isNull(),
        "L19_object_type": ~F.coalesce(F.col("object_type").isin(*OBJECT_TYPES), F.lit(False)) | is_blank(F.col("id")),
    }


def _true(c: Column) -> Column:
    """A condition in which null is no violation: what isn't there breaks no rule of this kind."""
    return F.coalesce(c, F.lit(False))


def _unlisted(name: str, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(name).isin(*values), F.lit(False))


def audit_rules() -> dict[str, Column]:
    c = F.col
    approved = c("approved_by").isNotNull()
    return {
        "L12_approval_pair": approved != c("approved_at").isNotNull(),
        "L12_approver_without_approval": approved & _unlisted("status", ("APPROVED", "EXECUTED")),
        "L12_approved_by_nobody": _true(c("status") == "APPROVED") & ~approved,
        "L13_agent_executed_alone": _true((c("actor_type") == "AGENT") & (c("status") == "EXECUTED")) & ~approved,
        "L13_approver_type_pair": approved != c("approver_type").isNotNull(),
        "L13_approver_is_no_human": approved & ~_true(c("approver_type") == "HUMAN"),
        "L13_approver_type": c("approver_type").isNotNull() & _unlisted("approver_type", ACTOR_TYPES),
        "L19_actor_type": _unlisted("actor_type", ACTOR_TYPES),
        "L19_audit_status": _unlisted("status", AUDIT_STATUS),
    }


def schema_version_rules() -> dict[str, Column]:
    """`object_types` and `link_types` are JSON texts."""
    array = lambda name: ~F.coalesce(F.col(name).rlike(r"\A\s*\[[\s\S]*\]\s*\z"), F.lit(False)) | F.try_parse_json(F.col(name)).isNull()
    return {
        "L14_agent_change_unaudited": ~_true(F.col("applied_via") == "MIGRATION") & F.col("audit_record_id").isNull(),
        "L14_object_types_no_array": array("object_types"),
        "L14_link_types_no_array": array("link_types"),
        "L19_applied_via": _unlisted("applied_via", APPLIED_VIA),
    }


def source_key_rules() -> dict[str, Column]:
    return {"L19_source_system": is_blank(F.col("source_system")), "L19_source_key": is_blank(F.col("source_key"))}


def proposal_rules() -> dict[str, Column]:
    c = F.col
    open_one, resolved = _true(c("status") == "PENDING"), _true(c("status").isin("CONFIRMED", "REJECTED"))
    return {
        "L1_score_range": ~_true(c("score").between(0, 1)),
        "L16_merged_with_itself": _true(c("survivor_id") == c("duplicate_id")),
        "L16_status": _unlisted("status", PROPOSAL_STATUS),
        "L16_resolved_pair": (open_one & (c("resolved_at").isNotNull() | c("resolution_audit_id").isNotNull())) | (resolved & c("resolved_at").isNull()),
    }


def run_rules() -> dict[str, Column]:
    return {"L17_run_id": F.coalesce(F.col("id") == "", F.lit(True)), "L17_finished_before_start": _true(F.col("finished_at") < F.col("started_at"))}


def pending_twice(proposals: DataFrame) -> DataFrame:
    """L16: objects that more than one pending proposal would merge away."""
    return repeated_keys(proposals, ["duplicate_id"], F.col("status") == "PENDING")


def unaddressed_audits(audits: DataFrame, addressed: DataFrame) -> DataFrame:
    """L18: audit records that address no object."""
    return audits.join(addressed.select(F.col("audit_record_id").alias("id")).distinct(), "id", "left_anti").select("id")


def value_breaks(typed: DataFrame) -> DataFrame:
    """(prop_row_id, object_type, property, problem) where a readable value breaks its declaration: not in
    the closed list, below the minimum, or an empty text.

    `typed`: see `property_table.typed_properties`; it is joined with the few declarations.
    """
    declared = [(t.name, p.name, list(p.enum), p.minimum, p.value_type == "STRING") for t in OBJECT_TYPES.values() for p in t.properties]
    registry = typed.sparkSession.createDataFrame(declared, "object_type string, property string, _enum array<string>, _minimum double, _text boolean")
    joined = typed.join(F.broadcast(registry), ["object_type", "property"])
    problem = (
        F.when((F.size("_enum") > 0) & ~F.array_contains("_enum", F.col("text")), "not in the closed list")
        .when(F.col("num") < F.col("_minimum"), "below the minimum")
        .when(F.col("_text") & (F.size("_enum") == 0) & (F.col("text") == ""), "empty")
    )
    found = joined.withColumn("problem", problem).where("problem is not null")
    return found.select("prop_row_id", "object_type", "property", "problem")


def declared_type_breaks(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """L18: property rows whose value_type isn't the declared one, or that aren't declared for the type of
    their object (ids compared as keys; rows of unknown objects don't come out)."""
    declared = [(t.name, p.name, p.value_type) for t in OBJECT_TYPES.values() for p in t.properties]
    registry = rows.sparkSession.createDataFrame(declared, "object_type string, property_name string, declared string")
    types = objects.groupBy(key(F.col("id")).alias("_k")).agg(F.min("object_type").alias("object_type"))
    keyed = rows.select("object_id", "property_name", "ordinal", "value_type", key(F.col("object_id")).alias("_k")).withColumn("_s", F.xxhash64("property_name", "ordinal", "value_type"))
    joined = salted_join(keyed, types, ["_k"], "_s", hot_keys(keyed, ["_k"])).join(F.broadcast(registry), ["object_type", "property_name"], "left")
    problem = F.when(F.col("declared").isNull(), "not declared").when(~_true(F.col("declared") == F.col("value_type")), "another value type")
    return joined.withColumn("problem", problem).where("problem is not null").select("object_id", "property_name", "ordinal", "value_type", "problem")


def broken_rules(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(row_key, rule) for each rule a row breaks: all rules in one scan, no shuffle."""
    names = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
    return df.select(key.cast("string").alias("row_key"), F.explode(names).alias("rule"))


def repeated_keys(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys with more than one row and their number (L6 edges, L7 property keys, L10 many-to-one)."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def missing_targets(df: DataFrame, column: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose `column` is not null and in no row of `targets` (L11). The references are reduced to their
    distinct values before the join, so hot ones cost a row a task; rows are joined back only for
    the values that are missing."""
    wanted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    missing = wanted.join(targets.select(F.col(target).alias(column)).distinct(), column, "left_anti")
    rows = df.where(F.col(column).isNotNull()).withColumn("_s", F.xxhash64(*df.columns))
    return salted_join(rows, missing.drop("_n"), [column], "_s", hot_keys(missing, [column], "_n")).drop("_s").select(*df.columns)


def broken_references(tables: dict[str, DataFrame], references: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """(field, row_key, target) of all references that lead nowhere. `references`: (table, column, its row
    key, target table, target column)."""
    parts = [
        missing_targets(tables[t].select(F.col(k).cast("string").alias("_row"), F.col(c).alias("_target")), "_target", tables[to], at)
        .select(F.lit(f"{t}.{c}").alias("field"), F.col("_row").alias("row_key"), F.col("_target").alias("target"))
        for t, c, k, to, at in references
    ]
    return reduce(DataFrame.unionByName, parts)


# The references between the tables of a graph.
REFERENCES = [
    ("object_properties", "object_id", "object_id", "objects", "id"), ("links", "from_id", "id", "objects", "id"), ("links", "to_id", "id", "objects", "id"),
    ("objects", "schema_version", "id", "schema_versions", "version"), ("objects", "merged_into_id", "id", "objects", "id"),
    ("object_source_keys", "object_id", "source_key", "objects", "id"), ("merge_proposals", "survivor_id", "id", "objects", "id"),
    ("merge_proposals", "duplicate_id", "id", "objects", "id"), ("merge_proposals", "resolution_audit_id", "id", "audit_records", "id"),
    ("audit_records", "schema_version", "id", "schema_versions", "version"), ("audit_record_objects", "audit_record_id", "object_id", "audit_records", "id"),
    ("audit_record_objects", "object_id", "audit_record_id", "objects", "id"), ("ingestion_runs", "audit_record_id", "id", "audit_records", "id"),
    ("schema_versions", "audit_record_id", "version", "audit_records", "id"),
]


def wrong_end_types(links: DataFrame, objects: DataFrame) -> DataFrame:
    """Links whose ends are objects of other types than the link type declares. Ids are compared as keys
    (trimmed, without regard to case), hot ends salted; ends without an object are no case."""
    types = objects.groupBy(key(F.col("id")).alias("_k")).agg(F.min("object_type").alias("t")).where("_k is not null")
    out = links.select("id", "link_type", "from_id", "to_id")
    for end in ("from", "to"):
        out = out.withColumn("_k", key(F.col(f"{end}_id")))
        out = salted_join(out, types, ["_k"], "id", hot_keys(out, ["_k"])).withColumnRenamed("t", f"{end}_type").drop("_k")
    declared = reduce(
        lambda e, t: e | ((F.col("link_type") == t.name) & (F.col("from_type") == t.source) & (F.col("to_type") == t.target)),
        LINK_TYPES.values(), F.lit(False),
    )
    return out.where(~declared).select("id", "link_type", "from_type", "to_type")


def cardinality_breaks(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """L18: (object_id, property_name, problem) where a single-valued property has several rows, a
    required one none, or the ordinals of a list aren't 0..n-1."""
    declared = [(t.name, p.name, p.multiple, p.required) for t in OBJECT_TYPES.values() for p in t.properties]
    registry = rows.sparkSession.createDataFrame(declared, "object_type string, property_name string, multiple boolean, required boolean")
    wanted = objects.groupBy(F.col("id").alias("object_id")).agg(F.min("object_type").alias("object_type")).join(F.broadcast(registry), "object_type")
    there = rows.groupBy("object_id", "property_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.count_distinct("ordinal").alias("different")
    )
    joined = wanted.join(there, ["object_id", "property_name"], "left")
    problem = (
        F.when(F.col("n").isNull(), F.when(F.col("required") & ~F.col("multiple"), "required missing"))
        .when(~F.col("multiple") & (F.col("n") > 1), "several rows")
        .when(F.col("multiple") & ((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("different") != F.col("n"))), "ordinals not contiguous")
    )
    return joined.withColumn("problem", problem).where("problem is not null").select("object_id", "property_name", "problem")


def graph_checks(objects: DataFrame, rows: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Every rule over a graph as a violation query: the gate of a commit."""
    return {
        "objects": broken_rules(objects, F.col("id"), object_rules()),
        "properties": broken_rules(rows, F.concat_ws("|", *PROPERTY_KEY), property_rules()),
        "links": broken_rules(links, F.col("id"), link_rules()),
        "L6_repeated_edge": repeated_keys(links, ["link_type", "from_id", "to_id"]),
        "L7_repeated_property": repeated_keys(rows, PROPERTY_KEY),
        "L10_many_to_one": repeated_keys(links, ["from_id"], F.col("link_type").isin([t.name for t in LINK_TYPES.values() if t.cardinality == "MANY_TO_ONE"])),
        "L11_property_object": missing_targets(rows, "object_id", objects, "id"),
        "L11_link_from": missing_targets(links, "from_id", objects, "id"),
        "L11_link_to": missing_targets(links, "to_id", objects, "id"),
        "end_types": wrong_end_types(links, objects),
        "L18_cardinality": cardinality_breaks(rows, objects),
    }
