"""Wide typed objects and their entity-attribute-value rows, with evidence; lookups on both."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.functions.skew import hot_keys, salted_join
from provgraph.model import OBJECT_TYPES, VALUE_TYPES, Property
from provgraph.operators.property_table import json_kind

EVIDENCE = ["confidence", "source_system", "source_record_id", "pipeline_run_id", "extracted_at", "method", "verified_by", "verified_at"]
ROW_COLUMNS = ["object_id", "property_name", "ordinal", "value", "value_type", *EVIDENCE]


def _json(value: Column, p: Property) -> Column:
    """The value as JSON text: quoted and escaped for strings, bare for numbers and booleans."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _evidence(t: Column) -> list[Column]:
    p = t["provenance"]
    return [
        t["confidence"].alias("confidence"), p["source_system"].alias("source_system"),
        p["source_record_id"].alias("source_record_id"), p["pipeline_run_id"].alias("pipeline_run_id"),
        p["extracted_at"].alias("extracted_at"), p["method"].alias("method"),
        t["verification"]["by"].alias("verified_by"), t["verification"]["at"].alias("verified_at"),
    ]


def _row_of(p: Property) -> Callable[[Column, Column], Column]:
    def row(t: Column, i: Column) -> Column:
        return F.struct(
            F.lit(p.name).alias("property_name"), i.alias("ordinal"), _json(t["value"], p).alias("value"),
            F.lit(p.value_type).alias("value_type"), *_evidence(t), (t.isNull() | t["value"].isNull()).alias("absent"),
        )

    return row


def explode_objects(wide: DataFrame, object_type: str) -> DataFrame:
    """One row per value of a wide frame (see `model.wide_schema`), in a single pass.

    A scalar has ordinal 0, an absent optional one no row, a list ordinals 0..n-1. Extra columns of
    `wide` are ignored.
    """
    rows = []
    for p in OBJECT_TYPES[object_type].properties:
        c = F.col(p.name) if p.multiple else F.array(F.col(p.name))
        rows.append(F.coalesce(F.transform(c, _row_of(p)), F.array()))
    out = wide.select(F.col("id").alias("object_id"), F.inline(F.concat(*rows)))
    return out.where("not absent").select(*ROW_COLUMNS)


def _tracked(p: Property) -> Column:
    kind = json_kind(F.col("value"))
    decoded = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
    text = F.when(kind == "string", decoded).when(kind.isin("number", "boolean"), F.col("value"))
    value = text.try_cast(VALUE_TYPES[p.value_type])
    verification = F.when(F.col("verified_by").isNotNull(), F.struct(F.col("verified_by").alias("by"), F.col("verified_at").alias("at")))
    provenance = F.struct("method", "source_system", "source_record_id", "pipeline_run_id", "extracted_at")
    return F.struct(value.alias("value"), F.col("confidence"), provenance.alias("provenance"), verification.alias("verification"))


def assemble_objects(rows: DataFrame, objects: DataFrame, object_type: str) -> DataFrame:
    """The wide frame of an object type from its rows: one conditional aggregation, one shuffle.

    A single-valued property takes its row of the smallest ordinal, a list all rows by ordinal (an
    empty array without rows). A value that is no JSON scalar, or doesn't fit the type, is null in
    its tracked value. Objects without rows have nulls; rows of other objects and undeclared
    properties are left out.
    """
    declared = OBJECT_TYPES[object_type].properties
    of_type = objects.where(F.col("object_type") == object_type).select(F.col("id").alias("object_id")).distinct()
    kept = rows.where(F.col("property_name").isin([p.name for p in declared])).join(of_type, "object_id", "right")
    aggregates = []
    for p in declared:
        mine = F.when(F.col("property_name") == p.name, F.struct(F.col("ordinal"), _tracked(p).alias("t")))
        if p.multiple:
            listed = F.sort_array(F.collect_list(F.when(F.col("property_name") == p.name, F.struct("ordinal", F.to_json(_tracked(p)).alias("j"), _tracked(p).alias("t")))))
            aggregates.append(F.transform(listed, lambda x: x["t"]).alias(p.name))
        else:
            aggregates.append(F.min_by(mine["t"], F.when(F.col("property_name") == p.name, F.col("ordinal"))).alias(p.name))
    return kept.groupBy(F.col("object_id").alias("id")).agg(*aggregates)


def property_rows(rows: DataFrame, object_id: str) -> DataFrame:
    """All rows of one object by property name and ordinal."""
    return rows.where(F.col("object_id") == object_id).orderBy("property_name", "ordinal")


def links_of(links: DataFrame, object_id: str, link_type: str | None = None) -> DataFrame:
    """Links with the object at either end, by id; an unknown object has none."""
    found = links.where((F.col("from_id") == object_id) | (F.col("to_id") == object_id))
    return (found.where(F.col("link_type") == link_type) if link_type is not None else found).orderBy("id")


def adjacency(links: DataFrame) -> DataFrame:
    """Every link seen from both ends: node, direction, other, and the link's columns. One scan."""
    ends = F.array(
        F.struct(F.col("from_id").alias("node"), F.lit("ALONG").alias("direction"), F.col("to_id").alias("other")),
        F.struct(F.col("to_id").alias("node"), F.lit("AGAINST").alias("direction"), F.col("from_id").alias("other")),
    )
    return links.select("*", F.inline(ends))


def _facts(rows: DataFrame, links: DataFrame) -> DataFrame:
    shared = ["confidence", "method", "source_system", "pipeline_run_id", "verified_by"]
    props = rows.select(F.lit("property").alias("fact"), F.concat_ws("|", "object_id", "property_name", "ordinal").alias("fact_key"), *shared)
    return props.unionByName(links.select(F.lit("link").alias("fact"), F.col("id").alias("fact_key"), *shared))


def review_queue(rows: DataFrame, links: DataFrame, below: float) -> DataFrame:
    """Unverified facts with less than `below` confidence, least first."""
    queue = _facts(rows, links).where(F.col("verified_by").isNull() & (F.col("confidence") < F.lit(below).cast("decimal(4,3)")))
    return queue.orderBy("confidence", "fact", "fact_key")


def pending_approvals(audits: DataFrame) -> DataFrame:
    """Proposed actions that wait for a decision, the newest first."""
    return audits.where(F.col("status") == "PROPOSED").orderBy(F.desc("proposed_at"), "id")


def touched_by_run(rows: DataFrame, links: DataFrame, run_id: str) -> DataFrame:
    """Every fact that a pipeline run wrote."""
    return _facts(rows, links).where(F.col("pipeline_run_id") == run_id)


def calibration(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Per fact kind and method: number, mean confidence, number verified."""
    return _facts(rows, links).groupBy("fact", "method").agg(
        F.count(F.lit(1)).alias("n_facts"), F.avg(F.col("confidence").cast("double")).alias("mean_confidence"),
        F.count("verified_by").alias("n_verified"),
    )


#: What an upsert leaves as the first row of a link has it: identity and verification.
KEPT_BY_UPSERT = ("id", "verified_by", "verified_at", "created_at")


def least_upsert(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Links keyed by (link_type, from_id, to_id): the least confidence of all rows, the provenance of the
    newest by `seq`, identity and verification (KEPT_BY_UPSERT) of the oldest: an upsert never verifies
    a link and never takes a verification away. Repeated rows and re-runs change nothing; one pass,
    combined before the shuffle. `seq` isn't null."""
    both = old.unionByName(new, allowMissingColumns=True)
    keys = ["link_type", "from_id", "to_id"]
    rest = [c for c in both.columns if c not in (*keys, "confidence", seq)]
    parts = {"_old": ([c for c in rest if c in KEPT_BY_UPSERT], F.min_by), "_new": ([c for c in rest if c not in KEPT_BY_UPSERT], F.max_by)}
    picked = [pick(F.struct(*columns), F.struct(seq, *columns)).alias(name) for name, (columns, pick) in parts.items() if columns]
    out = both.groupBy(*keys).agg(F.min("confidence").alias("confidence"), F.max(seq).alias(seq), *picked)
    return out.select(*keys, "confidence", seq, *(f"{name}.{c}" for name, (columns, _) in parts.items() for c in columns))


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`table` and the rows of `rows` whose key it lacks; the first of repeated new keys (by all
    columns) is taken. Present rows are never refreshed."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*[c for c in rows.columns if c not in keys])).alias("_r")) if len(rows.columns) > len(keys) else rows.distinct()
    first = first.select(*keys, "_r.*") if "_r" in first.columns else first
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti"))


def resolve_sources(source_keys: DataFrame, objects: DataFrame) -> DataFrame:
    """source_system, source_key and the object it stands for now: the survivor of a merged object,
    one hop. Objects with very many keys are salted."""
    ids = objects.select(F.col("id").alias("object_id"), "merged_into_id")
    keys = source_keys.withColumn("_s", F.xxhash64("source_system", "source_key"))
    return salted_join(keys, ids, ["object_id"], "_s", hot_keys(keys, ["object_id"])).select("source_system", "source_key", F.coalesce("merged_into_id", "object_id").alias("object_id"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two frames has more often than the other, with the side."""
    columns = sorted(a.columns)
    x, y = a.select(*columns), b.select(*columns)
    sides = [x.exceptAll(y).withColumn("side", F.lit("left")), y.exceptAll(x).withColumn("side", F.lit("right"))]
    return reduce(DataFrame.unionByName, sides)
