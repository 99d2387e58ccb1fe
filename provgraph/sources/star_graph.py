"""A graph over the star-schema tables: suppliers, parts, kits (orders), sites (nations), events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.operators.traverse import TypedGraph
from provgraph.runtime import load


def _confidence(base: int, spread: int, a: Column, fa: int, b: Column, fb: int) -> Column:
    return ((base + (a * fa + b * fb) % spread) * F.lit(0.001).cast("decimal(4,3)")).cast("decimal(4,3)")


def _name(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def star_objects(spark: SparkSession, d: str) -> DataFrame:
    """(id, object_type, merged_into_id)."""
    sides = [
        ("supplier", "s_suppkey", "SUP-", "SUPPLIER"), ("part", "p_partkey", "PART-", "PART"),
        ("orders", "o_orderkey", "DEV-", "DEVICE"), ("nation", "n_nationkey", "SITE-", "SITE"),
    ]
    frames = [load(spark, d, t).select(_name(p, F.col(c)).alias("id"), F.lit(kind).alias("object_type")) for t, c, p, kind in sides]
    errors = load(spark, d, "events").where("event_type = 'error'")
    frames.append(errors.select(_name("QE-", F.col("event_id")).alias("id"), F.lit("QUALITY_EVENT").alias("object_type")))
    return reduce(DataFrame.unionByName, frames).withColumn("merged_into_id", F.lit(None).cast("string"))


def star_links(spark: SparkSession, d: str) -> DataFrame:
    """(id, link_type, from_id, to_id, confidence)."""
    line, orders = load(spark, d, "lineitem"), load(spark, d, "orders")
    n_sup, n_part = (load(spark, d, t).count() for t in ("supplier", "part"))
    col = F.col
    supplies = line.select("l_suppkey", "l_partkey").distinct().select(
        F.lit("SUPPLIES").alias("link_type"), _name("SUP-", col("l_suppkey")).alias("from_id"), _name("PART-", col("l_partkey")).alias("to_id"),
        _confidence(500, 500, col("l_suppkey"), 31, col("l_partkey"), 17).alias("confidence"),
    )
    composed = line.select("l_orderkey", "l_partkey").distinct().select(
        F.lit("COMPOSED_OF").alias("link_type"), _name("DEV-", col("l_orderkey")).alias("from_id"), _name("PART-", col("l_partkey")).alias("to_id"),
        _confidence(600, 401, col("l_orderkey"), 13, col("l_partkey"), 7).alias("confidence"),
    )
    made = orders.join(load(spark, d, "customer"), col("o_custkey") == col("c_custkey")).select(
        F.lit("MANUFACTURED_AT").alias("link_type"), _name("DEV-", col("o_orderkey")).alias("from_id"), _name("SITE-", col("c_nationkey")).alias("to_id"),
        _confidence(700, 301, col("o_orderkey"), 11, col("c_nationkey"), 5).alias("confidence"),
    ).distinct()
    errors = load(spark, d, "events").where("event_type = 'error'")
    hits = [
        errors.select(
            F.lit(kind).alias("link_type"), _name("QE-", col("event_id")).alias("from_id"), _name(prefix, col(c) % n).alias("to_id"),
            _confidence(400, 601, col("event_id"), 7, col("user_id"), 3).alias("confidence"),
        )
        for kind, prefix, c, n in (("AFFECTS_SUPPLIER", "SUP-", "user_id", n_sup), ("AFFECTS_PART", "PART-", "event_id", n_part))
    ]
    out = reduce(DataFrame.unionByName, [supplies, composed, made, *hits])
    return out.select(F.concat_ws("|", "link_type", "from_id", "to_id").alias("id"), "*")


def star_graph(spark: SparkSession, d: str, by_part: bool = False) -> TypedGraph:
    """The same graph with a table for each type and whole-number keys. `by_part`: supplier edges are spread by
    part, so that they need no further exchange where all of them meet at parts."""
    line, orders, col = load(spark, d, "lineitem"), load(spark, d, "orders"), F.col
    errors = load(spark, d, "events").where("event_type = 'error'")
    size = lambda t: load(spark, d, t).count()

    def edges(rows: DataFrame, a: Column, b: Column, confidence: Column) -> DataFrame:
        return rows.select(a.cast("long").alias("source"), b.cast("long").alias("target"), confidence.alias("confidence"))

    pairs = lambda rows, a: rows.select(a, "l_partkey").distinct()
    # An order has few lines: spread by order, they need no further exchange where edges meet at devices.
    by_order = lambda: line.withColumn("l_orderkey", col("l_orderkey").cast("long")).select("l_orderkey", "l_partkey").repartition("l_orderkey")
    of_parts = lambda: line.withColumn("l_partkey", col("l_partkey").cast("long")).select("l_suppkey", "l_partkey").repartition("l_partkey") if by_part else line
    sites = orders.join(load(spark, d, "customer"), col("o_custkey") == col("c_custkey")).select(col("o_orderkey").cast("long").alias("o_orderkey"), "c_nationkey")
    sites = sites.repartition("o_orderkey").distinct()
    hit, user = col("event_id"), col("user_id")
    nodes = {
        "SUPPLIER": ("supplier", "s_suppkey", "SUP-"), "PART": ("part", "p_partkey", "PART-"), "DEVICE": ("orders", "o_orderkey", "DEV-"), "SITE": ("nation", "n_nationkey", "SITE-"),
    }
    frames = {kind: (load(spark, d, t).select(col(c).cast("long").alias("node")), prefix) for kind, (t, c, prefix) in nodes.items()}
    frames["QUALITY_EVENT"] = (errors.select(hit.cast("long").alias("node")), "QE-")
    return TypedGraph(
        {
            "SUPPLIES": lambda: edges(pairs(of_parts(), "l_suppkey"), col("l_suppkey"), col("l_partkey"), _confidence(500, 500, col("l_suppkey"), 31, col("l_partkey"), 17)),
            "COMPOSED_OF": lambda: edges(pairs(by_order(), "l_orderkey"), col("l_orderkey"), col("l_partkey"), _confidence(600, 401, col("l_orderkey"), 13, col("l_partkey"), 7)),
            "MANUFACTURED_AT": lambda: edges(sites, col("o_orderkey"), col("c_nationkey"), _confidence(700, 301, col("o_orderkey"), 11, col("c_nationkey"), 5)),
            "AFFECTS_SUPPLIER": lambda: edges(errors, hit, user % size("supplier"), _confidence(400, 601, hit, 7, user, 3)),
            "AFFECTS_PART": lambda: edges(errors, hit, hit % size("part"), _confidence(400, 601, hit, 7, user, 3)),
        },
        frames,
    )
