"""References to records that do not exist, were deleted before, or arrive afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.functions.skew import hot_keys, salted_join
from provgraph.runtime import cut


def parent_keys(target: str, df: DataFrame, key: Column, seen_at: Column, deleted_at: Column | None = None) -> DataFrame:
    """Rows of a referenced table in the long form of `failing_references`."""
    gone = F.lit(None).cast("timestamp") if deleted_at is None else deleted_at
    return df.select(
        F.lit(target).alias("target"), key.alias("key"), seen_at.alias("seen_at"), gone.alias("deleted_at")
    ).where(F.col("key").isNotNull())


def child_keys(
    src_table: str, ref_field: str, target: str, df: DataFrame, key: Column, row_key: Column, at: Column
) -> DataFrame:
    """Rows of a referring table in the long form of `failing_references`."""
    return df.select(
        F.lit(target).alias("target"),
        key.alias("key"),
        F.lit(src_table).alias("src_table"),
        F.lit(ref_field).alias("ref_field"),
        row_key.cast("string").alias("row_key"),
        at.alias("at"),
    ).where(F.col("key").isNotNull())


def failing_references(parents: list[DataFrame], children: list[DataFrame]) -> DataFrame:
    """(src_table, ref_field, row_key, status, period) of each reference that fails.

    Parent and child keys are put together in long form with a tag and grouped by (target, key);
    min, max and counts are combined before the shuffle, so a key with a third of all rows costs
    one row per task. Groups that can't fail (parent there in time and alive) end here. The rest
    are joined back to the child rows, hot keys salted.

    Status, first that holds: 'missing' (no parent row), 'late' (first seen after the reference),
    'deleted' (every parent row deleted, the last not after the reference). Null and blank keys
    must be null in `key` and are no references. A reference without a time can only be missing;
    its period is null. Repeated rows each count. Empty tables give an empty result, or all
    references as missing where the parent table is empty.
    """
    parent = reduce(DataFrame.unionByName, parents)
    child = reduce(DataFrame.unionByName, children)
    no_time = F.lit(None).cast("timestamp")
    tagged = parent.select(
        "target", "key", F.lit(1).alias("is_parent"), "seen_at", "deleted_at",
        F.col("deleted_at").isNull().cast("int").alias("alive"), no_time.alias("at"),
    ).unionByName(
        child.select(
            "target", "key", F.lit(0).alias("is_parent"), no_time.alias("seen_at"),
            no_time.alias("deleted_at"), F.lit(0).alias("alive"), "at",
        )
    )
    groups = tagged.groupBy("target", "key").agg(
        F.sum("is_parent").alias("n_parent"),
        F.sum(1 - F.col("is_parent")).alias("n_child"),
        F.min("seen_at").alias("first_seen"),
        F.max("deleted_at").alias("last_deleted"),
        F.sum("alive").alias("n_alive"),
        F.min("at").alias("min_at"),
        F.max("at").alias("max_at"),
    )
    suspects = groups.where(
        (F.col("n_child") > 0)
        & (
            (F.col("n_parent") == 0)
            | (F.col("first_seen") > F.col("min_at"))
            | ((F.col("n_alive") == 0) & (F.col("last_deleted") <= F.col("max_at")))
        )
    ).drop("min_at", "max_at")
    suspects = cut(suspects)  # few rows beside the input; used for the hot keys and for the join
    keys = ["target", "key"]
    joined = salted_join(child, suspects, keys, "row_key", hot_keys(suspects, keys, "n_child"))
    status = (
        F.when(F.col("n_parent") == 0, "missing")
        .when(F.col("first_seen") > F.col("at"), "late")
        .when((F.col("n_alive") == 0) & (F.col("last_deleted") <= F.col("at")), "deleted")
    )
    return (
        joined.withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select("src_table", "ref_field", "row_key", "status", F.date_format("at", "yyyy-MM").alias("period"))
    )


def failures_by_period(failing: DataFrame) -> DataFrame:
    """Counts of failing references per table, field, status and month."""
    return failing.groupBy("src_table", "ref_field", "status", "period").agg(F.count(F.lit(1)).alias("n_failing"))
