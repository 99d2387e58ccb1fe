"""Sinks: objects, links, graphs and whole ingest plans into a snapshot store, with audit and run records."""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.model import SCHEMA_VERSION
from provgraph.operators import constraints
from provgraph.operators.ingest import Plan, object_id
from provgraph.operators.tracked import ROW_COLUMNS, explode_objects, insert_absent, least_upsert
from provgraph.runtime import cut
from provgraph.store import ConstraintError, SnapshotStore

# The columns of the tables a store holds.
SCHEMAS = {
    "objects": "id string, object_type string, schema_version string, created_at timestamp, merged_into_id string, merged_at timestamp",
    "object_properties": "object_id string, property_name string, ordinal int, value string, value_type string, confidence decimal(4,3), source_system string, "
    "source_record_id string, pipeline_run_id string, extracted_at timestamp, method string, verified_by string, verified_at timestamp",
    "links": "id string, link_type string, from_id string, to_id string, confidence decimal(4,3), source_system string, source_record_id string, "
    "pipeline_run_id string, extracted_at timestamp, method string, verified_by string, verified_at timestamp, created_at timestamp, seq long",
    "object_source_keys": "source_system string, source_key string, object_id string, pipeline_run_id string, created_at timestamp",
    "audit_records": "id string, action_name string, actor string, actor_type string, proposed_at timestamp, approved_by string, approved_at timestamp, approver_type string, "
    "status string, justification string, input_payload string, before_state string, after_state string, schema_version string",
    "audit_record_objects": "audit_record_id string, object_id string",
    "ingestion_runs": "id string, started_at timestamp, finished_at timestamp, summary string, audit_record_id string",
}


def table(store: SnapshotStore, name: str) -> DataFrame:
    """A table of the store, empty where it isn't there yet."""
    return store.read(name) if name in store.tables() else store.spark.createDataFrame([], SCHEMAS[name])


def _shaped(df: DataFrame, name: str) -> DataFrame:
    """`df` with the columns of a table, nulls where it has none."""
    fields = [f.strip().split(" ", 1) for f in SCHEMAS[name].replace("(4,3)", "(4;3)").split(",")]
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t.replace(";", ",")).alias(c) for c, t in fields))


def object_rows(wide: DataFrame, object_type: str, at) -> tuple[DataFrame, DataFrame]:
    """(objects, object_properties) rows of a wide frame."""
    rows = wide.select("id", F.lit(object_type).alias("object_type"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(at).alias("created_at"))
    return _shaped(rows, "objects"), explode_objects(wide, object_type)


def link_rows(links: DataFrame, at, seq: Column) -> DataFrame:
    """Rows of `links` with an id made from type and ends, so that a repeated task gives the same one."""
    made = object_id("link", F.concat_ws("\0", "link_type", "from_id", "to_id"))
    return _shaped(links.withColumns({"id": F.col("id") if "id" in links.columns else made, "created_at": F.lit(at), "seq": seq}), "links")


def audit_record(store: SnapshotStore, record_id: str, action: str, actor: str, at, justification: str, payload: dict, after: dict) -> DataFrame:
    """One executed audit record by a human."""
    row = {
        "id": record_id, "action_name": action, "actor": actor, "actor_type": "HUMAN", "proposed_at": at, "status": "EXECUTED", "justification": justification,
        "input_payload": json.dumps(payload, sort_keys=True), "after_state": json.dumps(after, sort_keys=True), "schema_version": SCHEMA_VERSION,
    }
    return _shaped(store.spark.range(1).select(*(F.lit(v).alias(c) for c, v in row.items())), "audit_records")


def _refused(properties: DataFrame, links: DataFrame) -> list[DataFrame]:
    """The rules new rows must keep: of evidence, keys, links, and no empty text."""
    empty = {"B21_empty_text": F.col("value") == '""'}
    return [
        constraints.broken_rules(properties, F.concat_ws("|", *constraints.PROPERTY_KEY), constraints.property_rules() | empty),
        constraints.broken_rules(links, F.col("id"), constraints.link_rules()),
    ]


def insert_graph(store: SnapshotStore, wides: dict[str, DataFrame], links: DataFrame, audit_id: str, at) -> int:
    """Insert objects (wide frames by type) and links with one audit record that addresses all objects;
    the new version. Rows that break a rule, and ids or edges that are there already, refuse the
    whole insert with a ConstraintError."""
    parts = [object_rows(wide, kind, at) for kind, wide in wides.items()]
    objects = cut(reduce(DataFrame.unionByName, [p[0] for p in parts])) if parts else table(store, "objects").limit(0)
    properties = cut(reduce(DataFrame.unionByName, [p[1] for p in parts]).select(*ROW_COLUMNS)) if parts else table(store, "object_properties").limit(0)
    new = cut(link_rows(links, at, F.lit(store.version() + 1).cast("long") * F.lit(2**40)))
    checks = _refused(properties, new) + [
        constraints.repeated_keys(table(store, "objects").select("id").unionByName(objects.select("id")), ["id"]),
        constraints.repeated_keys(table(store, "links").unionByName(new), ["link_type", "from_id", "to_id"]),
    ]
    audit = audit_record(store, audit_id, "ingestGraph", "system-ingest", at, "graph insert", {}, {"objectCount": objects.count(), "linkCount": new.count()})
    return store.commit({
        "objects": table(store, "objects").unionByName(objects), "object_properties": table(store, "object_properties").unionByName(properties),
        "links": table(store, "links").unionByName(new), "audit_records": table(store, "audit_records").unionByName(audit),
        "audit_record_objects": table(store, "audit_record_objects").unionByName(objects.select(F.lit(audit_id).alias("audit_record_id"), F.col("id").alias("object_id"))),
    }, checks)


def apply_plan(store: SnapshotStore, plan: Plan, run_id: str, at: dt.datetime, finished_at: dt.datetime | None = None) -> int:
    """Bring an ingest plan into the store; the new version.

    A run id that was used before is a ValueError; the run is recorded as running before anything
    else. Objects whose source key is registered are left as they are (no refresh); of several new
    rows of one key the first line counts. Links are upserted: least confidence, newest provenance,
    verification kept. An audit record addresses every object of the plan, and the run is finished
    with the report. Rows that break a rule refuse all of it, and the run stays unfinished.
    """
    runs = table(store, "ingestion_runs")
    if not runs.where(F.col("id") == run_id).isEmpty():
        raise ValueError(f"run {run_id} was there before")
    started = _shaped(store.spark.range(1).select(F.lit(run_id).alias("id"), F.lit(at).alias("started_at"), F.lit('{"phase":"running"}').alias("summary")), "ingestion_runs")
    store.commit({"ingestion_runs": runs.unionByName(started)})
    planned = cut(plan.objects().withColumn("line", F.substring_index("source_record_id", ":", -1).cast("long")))
    keys = ["source_system", "source_key"]
    rest = ["id", "object_type", "source_record_id"]
    first = planned.groupBy(*keys).agg(F.min_by(F.struct(*rest), "line").alias("r")).select(*keys, "r.*")
    new = cut(first.join(table(store, "object_source_keys").select(*keys), keys, "left_anti"))
    objects = _shaped(new.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "created_at": F.lit(at)}), "objects")
    of_new = new.select(F.col("id").alias("object_id"), "source_record_id")
    properties = cut(plan.property_rows(run_id, at).join(of_new, ["object_id", "source_record_id"], "left_semi").select(*ROW_COLUMNS))
    evidence = {"method": F.lit("DIRECT"), "pipeline_run_id": F.lit(run_id), "extracted_at": F.lit(at)}
    line = F.substring_index("source_record_id", ":", -1).cast("long")
    links = cut(link_rows(plan.links().withColumns(evidence), at, F.lit(store.version() + 1).cast("long") * F.lit(2**40) + line))
    report = {"accepted": dict(tuple(r) for r in plan.accepted_counts().collect()), "tallies": dict(tuple(r) for r in plan.tallies().collect())}
    audit_id = f"audit-{run_id}"
    audit = audit_record(store, audit_id, "ingestSapWeek2", "system-ingest", at, f"Week 2 SAP CSV ingest ({run_id})", {"pipelineRunId": run_id, "reportSummary": report},
                         {"objectCount": planned.count(), "linkCount": links.count()})
    finished = _shaped(started.drop("finished_at", "summary", "audit_record_id").withColumns({
        "finished_at": F.lit(finished_at or at), "summary": F.lit(json.dumps(report, sort_keys=True)), "audit_record_id": F.lit(audit_id),
    }), "ingestion_runs")
    source_keys = _shaped(new.withColumnRenamed("id", "object_id").withColumns({"pipeline_run_id": F.lit(run_id), "created_at": F.lit(at)}), "object_source_keys")
    return store.commit({
        "objects": insert_absent(table(store, "objects"), objects, ["id"]), "object_properties": table(store, "object_properties").unionByName(properties),
        "links": _shaped(least_upsert(table(store, "links"), links), "links"), "object_source_keys": table(store, "object_source_keys").unionByName(source_keys),
        "audit_records": table(store, "audit_records").unionByName(audit),
        "audit_record_objects": table(store, "audit_record_objects").unionByName(planned.select(F.lit(audit_id).alias("audit_record_id"), F.col("id").alias("object_id")).distinct()),
        "ingestion_runs": runs.unionByName(finished),
    }, _refused(properties, links))


__all__ = ["ConstraintError", "SCHEMAS", "apply_plan", "audit_record", "insert_graph", "link_rows", "object_rows", "table"]
