"""Queries of records about the graph: rules with planted violations, audits, updates, references.

The given tables break few of the rules, and have no audit, run or proposal tables. Here rows that break
each rule are derived from whole given tables by plain conditions on their columns.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph import model
from provgraph.operators import apply, constraints, ingest, tracked, traverse
from provgraph.plans.graph import _best, _bundle, _clean_rows
from provgraph.plans.preparation import typed
from provgraph.runtime import load, shared_folder
from provgraph.sources import csv_bundle
from provgraph.streaming import upserts
from provgraph.store import SnapshotStore, audit_history, states_of, update_values


def _last(c: str = "id") -> Column:
    return F.substring(F.trim(c), -1, 1)


def _text(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def planted_links(spark: SparkSession, d: str) -> DataFrame:
    x, c = _last(), F.col
    return load(spark, d, "links").withColumns({
        "confidence": F.when(x == "0", F.lit(1.5)).otherwise(c("confidence")).cast("decimal(4,3)"),
        "method": F.when(x == "1", "GUESS").otherwise(c("method")),
        "verified_by": F.when(x == "2", "anna").otherwise(c("verified_by")),
        "source_record_id": F.when(x != "3", c("source_record_id")),
        "pipeline_run_id": F.when(x != "4", c("pipeline_run_id")),
        "to_id": F.when(x == "5", c("from_id")).otherwise(c("to_id")),
        "link_type": F.when(x == "6", "KNOWS").otherwise(c("link_type")),
    })


def planted_objects(spark: SparkSession, d: str) -> DataFrame:
    x, c = _last(), F.col
    return load(spark, d, "objects").withColumns({
        "merged_into_id": F.when(x == "0", c("id")).otherwise(c("merged_into_id")),
        "merged_at": F.when(x == "1", c("created_at")).otherwise(c("merged_at")),
        "object_type": F.when(x == "2", "PLANET").otherwise(c("object_type")),
    })


def audits(spark: SparkSession, d: str) -> DataFrame:
    o, cust = F.col("o_orderkey"), F.col("o_custkey")
    by = F.when(o % 3 == 0, "anna")
    return load(spark, d, "orders").select(
        _text("A-", o).alias("id"), F.when(cust % 5 == 0, "AGENT").when(cust % 5 == 1, "ROBOT").otherwise("HUMAN").alias("actor_type"),
        F.when(o % 5 == 0, "PROPOSED").when(o % 5 == 1, "APPROVED").when(o % 5 == 2, "REJECTED").when((o % 5 == 4) & (cust % 7 == 0), "DONE").otherwise("EXECUTED").alias("status"),
        by.alias("approved_by"), F.when((cust % 4 != 0) & by.isNotNull(), F.col("o_orderdate")).alias("approved_at"),
        F.when(cust % 6 == 0, F.lit(None)).when(cust % 6 == 1, "AGENT").when(cust % 6 == 2, "CLERK").when(by.isNotNull(), "HUMAN").alias("approver_type"),
        F.col("o_orderdate").alias("proposed_at"),
    )


def addressed(spark: SparkSession, d: str) -> DataFrame:
    line = load(spark, d, "lineitem").where("l_quantity > 25")
    return line.select(_text("A-", F.col("l_orderkey")).alias("audit_record_id"), _text("PART-", F.col("l_partkey")).alias("object_id")).distinct()


def proposals(spark: SparkSession, d: str) -> DataFrame:
    o, cust = F.col("o_orderkey"), F.col("o_custkey")
    return load(spark, d, "orders").select(
        _text("P-", o).alias("id"), _text("S-", cust % 50).alias("survivor_id"), _text("S-", o % 70).alias("duplicate_id"),
        ((o % 1300) * F.lit(0.001).cast("decimal(4,3)")).cast("decimal(4,3)").alias("score"),
        F.when(o % 4 == 0, "PENDING").when(o % 4 == 1, "CONFIRMED").when(o % 4 == 2, "REJECTED").otherwise("OPEN").alias("status"),
        F.when(cust % 3 == 0, F.col("o_orderdate")).alias("resolved_at"), F.when(cust % 9 == 0, _text("A-", o)).alias("resolution_audit_id"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    o, cust, at = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    return load(spark, d, "orders").select(
        F.when(o % 10 == 0, "").otherwise(_text("run-", o)).alias("id"), at.alias("started_at"),
        F.when(cust % 3 == 1, at - F.expr("INTERVAL 1 DAY")).when(cust % 3 == 2, at + F.expr("INTERVAL 1 DAY")).alias("finished_at"),
    )


def schema_versions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return load(spark, d, "nation").select(
        F.col("n_name").alias("version"), F.when(k % 4 == 0, "[1]").when(k % 4 == 1, "{}").when(k % 4 == 2, "[broken").otherwise("[]").alias("object_types"),
        F.when(k % 5 != 0, "[]").alias("link_types"), F.when(k % 3 == 0, "MIGRATION").when(k % 3 == 1, "AGENT_PROPOSAL").otherwise("HAND").alias("applied_via"),
        F.when(k % 2 == 0, "A-1").alias("audit_record_id"),
    )


def _tallied(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    return constraints.broken_rules(df, key, rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"))


def l_planted_links(spark: SparkSession, d: str) -> DataFrame:
    return _tallied(planted_links(spark, d), F.col("id"), constraints.link_rules())


def l_planted_objects(spark: SparkSession, d: str) -> DataFrame:
    return _tallied(planted_objects(spark, d), F.col("id"), constraints.object_rules())


def l11_planted_end_types(spark: SparkSession, d: str) -> DataFrame:
    return constraints.wrong_end_types(planted_links(spark, d), load(spark, d, "objects"))


def l12_audit_violations(spark: SparkSession, d: str) -> DataFrame:
    return constraints.broken_rules(audits(spark, d), F.col("id"), constraints.audit_rules())


def l14_schema_violations(spark: SparkSession, d: str) -> DataFrame:
    return constraints.broken_rules(schema_versions(spark, d), F.col("version"), constraints.schema_version_rules())


def l16_proposal_violations(spark: SparkSession, d: str) -> DataFrame:
    return constraints.broken_rules(proposals(spark, d), F.col("id"), constraints.proposal_rules())


def l16_pending_twice(spark: SparkSession, d: str) -> DataFrame:
    return constraints.pending_twice(proposals(spark, d))


def l17_run_violations(spark: SparkSession, d: str) -> DataFrame:
    return _tallied(runs(spark, d), F.col("id"), constraints.run_rules())


def l19_source_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = load(spark, d, "vendor_master").select("line_no", F.when(F.col("line_no") % 9 == 0, " ").otherwise("SAP").alias("source_system"), F.col("LIFNR").alias("source_key"))
    return constraints.broken_rules(keys, F.col("line_no"), constraints.source_key_rules())


def l11_all_references(spark: SparkSession, d: str) -> DataFrame:
    """Every reference of the tables that can be derived, with the number of rows that lead nowhere."""
    objects = load(spark, d, "objects")
    merged = objects.where("merged_into_id IS NOT NULL").select("id", F.col("merged_into_id").alias("survivor_id"), F.col("id").alias("duplicate_id"), F.lit(None).cast("string").alias("resolution_audit_id"))
    tables = {
        "object_properties": load(spark, d, "object_properties"), "links": load(spark, d, "links"), "objects": objects, "merge_proposals": merged,
        "schema_versions": spark.createDataFrame([("0.1.0", "A-1")], "version string, audit_record_id string"), "audit_records": audits(spark, d).withColumn("schema_version", F.lit("9.9.9")),
        "audit_record_objects": addressed(spark, d), "ingestion_runs": runs(spark, d).withColumn("audit_record_id", F.concat(F.lit("A-"), F.substring("id", 5, 2))),
        "object_source_keys": load(spark, d, "object_properties").select(F.col("source_record_id").alias("source_key"), "object_id"),
    }
    return constraints.broken_references(tables, constraints.REFERENCES).groupBy("field").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("target").alias("n_targets"))


def l18_unaddressed_audits(spark: SparkSession, d: str) -> DataFrame:
    return constraints.unaddressed_audits(audits(spark, d), addressed(spark, d))


def l18_declared_types(spark: SparkSession, d: str) -> DataFrame:
    found = constraints.declared_type_breaks(load(spark, d, "object_properties"), load(spark, d, "objects"))
    return found.groupBy("property_name", "value_type", "problem").agg(F.count(F.lit(1)).alias("n_rows"))


def b21_value_breaks(spark: SparkSession, d: str) -> DataFrame:
    return constraints.value_breaks(typed(spark, d).where("state = 'ok'"))


def b15_pending_approvals(spark: SparkSession, d: str) -> DataFrame:
    return tracked.pending_approvals(audits(spark, d)).select("id", "actor_type", "proposed_at")


def b2_property_rows_of_one(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "object_properties")
    most = rows.groupBy("object_id").count().orderBy(F.desc("count"), "object_id").head()[0]
    return tracked.property_rows(rows, most).select("object_id", "property_name", "ordinal", "value", "confidence", "prop_row_id")


def c2_audit_history(spark: SparkSession, d: str) -> DataFrame:
    return audit_history(audits(spark, d), addressed(spark, d), "PART-1").select("id", "status", "proposed_at")


def d7_upsert_keeps_verification(spark: SparkSession, d: str) -> DataFrame:
    """Two runs that share their keys; some links of the first are verified, none of the second."""
    line, c = load(spark, d, "lineitem"), F.col
    run = F.when(c("l_returnflag") == "N", 1).otherwise(0)
    rows = line.select(
        F.lit("SUPPLIES").alias("link_type"), c("l_suppkey").alias("from_id"), (c("l_partkey") % 25).alias("to_id"),
        F.round(F.lit(0.4) + c("l_discount"), 3).cast("decimal(4,3)").alias("confidence"),
        F.concat_ws(":", F.concat(F.lit("run-"), run.cast("string")), "l_orderkey", "l_linenumber").alias("source_record_id"),
        F.when((run == 0) & (c("l_orderkey") % 3 == 0), "anna").alias("verified_by"),
        (c("l_orderkey").cast("long") * 8 + c("l_linenumber") + run.cast("long") * F.lit(2**50)).alias("seq"), run.alias("run"),
    )
    return tracked.least_upsert(rows.where("run = 0").drop("run"), rows.where("run = 1").drop("run"))


def _changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _clean_rows(spark, d)
    names = rows.where(F.col("property_name").isin("deviceName", "status") & (F.col("ordinal") == 0))
    return rows, names.select("object_id", "property_name", F.concat(F.lit('"new '), "property_name", F.lit('"')).alias("value"))


def k11_updated_values(spark: SparkSession, d: str) -> DataFrame:
    rows, changes = _changes(spark, d)
    out = update_values(rows, changes, dt.datetime(2026, 1, 15, 9, 30), "audit-1", ["status"])
    return out.select("object_id", "property_name", "ordinal", "value", "confidence", "method", "source_system", "source_record_id", "pipeline_run_id", "extracted_at")


def k10_states(spark: SparkSession, d: str) -> DataFrame:
    return states_of(*_changes(spark, d))


def h3_countries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "vendor_master").groupBy(ingest.country(F.col("LAND1")).alias("country")).agg(F.count(F.lit(1)).alias("n_rows"))


def h13_canonical_results(spark: SparkSession, d: str) -> DataFrame:
    p = model.SUPPLIER_DEVICE_RISK
    return traverse.canonical_results(_best(spark, d, p, "SUP-0"), p)


def m1_registry(spark: SparkSession, d: str) -> DataFrame:
    """The declared properties of the registry beside the given catalog: one row per declaration."""
    rows = [(t.name, p.name, p.value_type, p.multiple) for t in model.OBJECT_TYPES.values() for p in t.properties]
    mine = spark.createDataFrame(rows, "object_type string, property_name string, value_type string, is_multiple boolean").withColumn("declared", F.lit(True))
    given = load(spark, d, "property_catalog").withColumn("given", F.lit(True))
    both = mine.join(given, ["object_type", "property_name", "value_type", "is_multiple"], "full")
    return both.select("object_type", "property_name", "value_type", "is_multiple", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("given", F.lit(False)).alias("given"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def a6_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The vendors written as CSV files and read from there, with line numbers in each file."""
    path, columns = _folder(spark, "csv"), csv_bundle.FILES["vendor_master"]
    csv_bundle.write_csv(load(spark, d, "vendor_master").select(*columns), path)
    rows = csv_bundle.read_csv_rows(spark, path, columns)
    return rows.select(*columns, (F.col("line") > 1).alias("numbered"))


def a9_ingested_twice(spark: SparkSession, d: str) -> DataFrame:
    """All five files applied to a new store by two runs, the second with half the confidence: rows and
    least confidence of each table. Vendors without a country get 'ZZ', as an empty one is refused."""
    bundle = _bundle(spark, d)
    country = F.when(F.trim(F.regexp_replace(F.coalesce("LAND1", F.lit("")), r"\s+", " ")) == "", "ZZ").otherwise(F.col("LAND1"))
    family = F.when(F.trim(F.regexp_replace(F.coalesce("PRODUCT_FAMILY", F.lit("")), r"\s+", " ")) == "", "none").otherwise(F.col("PRODUCT_FAMILY"))
    bundle["vendor_master"] = bundle["vendor_master"].withColumn("LAND1", country)
    bundle["device_master"] = bundle["device_master"].withColumn("PRODUCT_FAMILY", family)
    store = SnapshotStore(spark, _folder(spark, "store").removeprefix("file:"))
    at = dt.datetime(2026, 1, 15, 9, 30)
    apply.apply_plan(store, ingest.Plan(bundle), "run-1", at)
    for file in ("supply_relationship", "device_bom"):
        bundle[file] = bundle[file].withColumn("CONFIDENCE", F.lit("0.45"))
    apply.apply_plan(store, ingest.Plan(bundle), "run-2", at)
    names = ["objects", "object_properties", "links", "object_source_keys", "audit_records", "audit_record_objects", "ingestion_runs"]
    parts = []
    for name in names:
        rows = store.read(name)
        least = F.max("confidence") if "confidence" in rows.columns else F.lit(None).cast("decimal(4,3)")
        parts.append(rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), least.alias("most_confidence")))
    return reduce(DataFrame.unionByName, parts)


def i_streamed_upserts(spark: SparkSession, d: str) -> DataFrame:
    """The two runs of d7_upsert_keeps_verification as files of a stream, upserted batch by batch."""
    source, line, c = _folder(spark, "stream"), load(spark, d, "lineitem"), F.col
    run = F.when(c("l_returnflag") == "N", 1).otherwise(0)
    rows = line.select(
        F.lit("SUPPLIES").alias("link_type"), c("l_suppkey").cast("string").alias("from_id"), (c("l_partkey") % 25).cast("string").alias("to_id"),
        F.round(F.lit(0.4) + c("l_discount"), 3).cast("decimal(4,3)").alias("confidence"),
        F.concat(F.lit("run-"), run.cast("string")).alias("source_record_id"), F.when(run == 0, "anna").alias("verified_by"), run.alias("run"),
    )
    store = SnapshotStore(spark, _folder(spark, "store").removeprefix("file:"))
    for r in (0, 1):
        rows.where(F.col("run") == r).drop("run").write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.drop("run").schema).parquet(source)
        upserts.upsert_links(stream, store, f"{source}-offsets").awaitTermination()
    return store.read("links").select("from_id", "to_id", "confidence", "source_record_id", "verified_by")


def i_windows(spark: SparkSession, d: str) -> DataFrame:
    """Least confidence of links per week and type, from a stream of the links table."""
    links = load(spark, d, "links").select("link_type", "confidence", "created_at")
    source, out, offsets = (_folder(spark, name) for name in ("stream", "windows", "offsets"))
    links.write.parquet(source)
    stream = spark.readStream.schema(links.schema).parquet(source)
    counted = upserts.confidence_by_window(stream, "created_at", "7 days", "3650 days")
    counted.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).outputMode("complete").option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


QUERIES = {
    f.__name__: f
    for f in (
        l_planted_links, l_planted_objects, l11_planted_end_types, l12_audit_violations, l14_schema_violations, l16_proposal_violations,
        l16_pending_twice, l17_run_violations, l19_source_keys, l11_all_references, l18_unaddressed_audits, l18_declared_types, b21_value_breaks,
        b15_pending_approvals, b2_property_rows_of_one, c2_audit_history, d7_upsert_keeps_verification, k11_updated_values, k10_states,
        h3_countries, h13_canonical_results, m1_registry, a6_csv_round_trip, a9_ingested_twice, i_streamed_upserts, i_windows,
    )
}
