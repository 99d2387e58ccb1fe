"""Versioned snapshots of graph tables: parquet folders and an atomic pointer, one writer.

A commit writes every table to a new folder and then moves the pointer file onto the old one, so
readers see the old or the new snapshot, never a mixture. A commit with violations is refused.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.model import METHODS


class ConstraintError(ValueError):
    """A commit breaks integrity rules."""


class SnapshotStore:
    """Tables under `root`, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)

    def _pointer(self) -> str:
        return os.path.join(self.root, "CURRENT")

    def _state(self) -> dict:
        if not os.path.exists(self._pointer()):
            return {"version": 0, "tables": {}, "buckets": {}}
        with open(self._pointer(), encoding="utf-8") as f:
            return {"buckets": {}} | json.load(f)

    def tables(self) -> dict[str, str]:
        """Table name -> folder of the current snapshot; empty before the first commit. A table in buckets
        (see `upsert`) stands with the folder of its first write."""
        return self._state()["tables"]

    def read(self, name: str) -> DataFrame:
        state = self._state()
        folders = sorted(f for b, f in state["buckets"].get(name, {}).items() if b != "n") or [state["tables"][name]]
        return self.spark.read.parquet(*folders)

    def commit(self, frames: dict[str, DataFrame], checks: list[DataFrame] = ()) -> int:
        """Write `frames`, keep the other tables, and publish; the new version number. `checks` are
        violation queries over the frames to come; any row of any of them refuses the commit."""
        broken = [c for c in checks if not c.isEmpty()]
        if broken:
            raise ConstraintError(f"{len(broken)} rules are broken, for instance by {broken[0].head()}")
        state = self._state()
        version, tables, buckets = state["version"] + 1, state["tables"], state["buckets"]
        for name, df in frames.items():
            folder = self._new_folder(name, version)
            df.write.parquet(folder)
            tables[name] = folder
            buckets.pop(name, None)
        return self._publish(version, tables, buckets)

    def _new_folder(self, name: str, version: int) -> str:
        return os.path.join(self.root, f"{name}-{version}-{uuid.uuid4().hex[:8]}")

    def _publish(self, version: int, tables: dict, buckets: dict) -> int:
        ready = f"{self._pointer()}.{uuid.uuid4().hex}"
        with open(ready, "w", encoding="utf-8") as f:
            json.dump({"version": version, "tables": tables, "buckets": buckets}, f, sort_keys=True)
        os.replace(ready, self._pointer())
        return version

    def upsert(self, name: str, new: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], n_buckets: int = 64) -> int:
        """Merge `new` into a table that is kept in buckets of its keys: only the buckets in which `new` has
        rows are read and written again (the first upsert of a plain table writes all of it into
        buckets). `merge` takes the old and the new rows of those buckets and gives the rows to keep.
        `n_buckets` holds for a table's first upsert."""
        state = self._state()
        version, tables, buckets = state["version"] + 1, state["tables"], state["buckets"]
        mine = buckets.get(name)
        n = mine["n"] if mine else n_buckets
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
        if mine:
            # At most as many numbers as there are buckets.
            touched = {str(r[0]) for r in new.select(bucket).distinct().collect()}
            folders = [f for b, f in mine.items() if b in touched]
            old = self.spark.read.parquet(*folders) if folders else new.where(F.lit(False))
        else:
            old = self.read(name) if name in tables else new.where(F.lit(False))
        folder = self._new_folder(name, version)
        merge(old, new).withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        written = {d.removeprefix("_bucket="): os.path.join(folder, d) for d in os.listdir(folder) if d.startswith("_bucket=")}
        if not written:
            return state["version"]
        buckets[name] = {**(mine or {}), "n": n, **written}
        tables[name] = tables.get(name, folder)
        return self._publish(version, tables, buckets)

    def prune(self) -> None:
        """Delete the folders that the current snapshot doesn't use: readers of older ones lose them."""
        state = self._state()
        inner = [f for folders in state["buckets"].values() for b, f in folders.items() if b != "n"]
        used = {os.path.basename(f) for n, f in state["tables"].items() if n not in state["buckets"]} | {os.path.basename(os.path.dirname(f)) for f in inner}
        for name in os.listdir(self.root):
            path = os.path.join(self.root, name)
            if os.path.isdir(path) and name not in used:
                shutil.rmtree(path)

    def version(self) -> int:
        return self._state()["version"]

    def empty(self, names: list[str]) -> int:
        """A snapshot in which these tables have no rows (their schemas stay)."""
        return self.commit({n: self.read(n).where(F.lit(False)) for n in names})


def audit_history(audits: DataFrame, addressed: DataFrame, object_id: str) -> DataFrame:
    """The audit records that address an object, oldest first."""
    mine = addressed.where(F.col("object_id") == object_id).select(F.col("audit_record_id").alias("id")).distinct()
    return audits.join(mine, "id", "left_semi").orderBy("proposed_at", "id")


def ingestion_run(spark: SparkSession, run_id: str, tallies: DataFrame, started_at, finished_at) -> DataFrame:
    """One row about a finished run: id, times and its report as JSON (tallies have a closed list of
    codes, so the report is small)."""
    report = tallies.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n"))))).alias("summary"))
    return report.select(F.lit(run_id).alias("id"), F.lit(started_at).alias("started_at"), F.lit(finished_at).alias("finished_at"), "summary")


def states_of(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """(object_id, before, after) of the objects that `changes` (object_id, property_name, value) touch: JSON
    objects from property name to JSON value, names in order, of the changed properties only."""
    old = rows.where("ordinal = 0").select("object_id", "property_name", F.col("value").alias("old"))
    both = changes.select("object_id", "property_name", F.col("value").alias("new")).join(old, ["object_id", "property_name"])

    def state(column: str) -> Column:
        pairs = F.transform(F.sort_array(F.collect_list(F.struct("property_name", column))), lambda x: F.concat(F.lit('"'), x["property_name"], F.lit('":'), x[column]))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))

    return both.groupBy("object_id").agg(state("old").alias("before"), state("new").alias("after"))


def update_values(rows: DataFrame, changes: DataFrame, at, audit_id: str, action_only: list[str] = (), source: str = "ACTION") -> DataFrame:
    """`rows` with the values of `changes` (object_id, property_name, value) put in at ordinal 0,
    stamped as certain human entries. A change of an action-only property from another source, or
    one that meets no row, is a ValueError."""
    if source != "ACTION" and not changes.where(F.col("property_name").isin(list(action_only))).isEmpty():
        raise ValueError("an action-only property can be changed by an action only")
    keys = ["object_id", "property_name"]
    if not changes.join(rows.where("ordinal = 0"), keys, "left_anti").isEmpty():
        raise ValueError("a change meets no row")
    new = changes.select(*keys, F.lit(0).alias("ordinal"), F.col("value").alias("_new"))
    stamp = {
        "value": F.col("_new"), "confidence": F.lit(1).cast("decimal(4,3)"), "method": F.lit(METHODS[3]), "source_system": F.lit("ACTION"),
        "source_record_id": F.lit(audit_id), "pipeline_run_id": F.lit(None).cast("string"), "extracted_at": F.lit(at),
    }
    joined = rows.join(new, [*keys, "ordinal"], "left")
    changed = {c: F.when(F.col("_new").isNotNull(), v).otherwise(F.col(c)) for c, v in stamp.items() if c in rows.columns}
    return joined.withColumns(changed).select(*rows.columns)
