"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.functions.text import key
from provgraph.llm.components import components
from provgraph.llm.leakage import leaked_items
from provgraph.llm.lookalike import Rewriter, classes, look_alike_pairs, plain_form_rewriter, plain_texts, same_looking_classes, same_looking_pairs
from provgraph.llm.names import same_entities
from provgraph.llm.packing import pack, packing_report, token_counts
from provgraph.llm.sql import ORACLE_SQL as ORACLE_SQL
from provgraph.llm.survivors import surviving_rows
from provgraph.runtime import cut, load


def _groups(spark: SparkSession, d: str) -> DataFrame:
    objects = load(spark, d, "objects")
    return components(objects.select(key(F.col("id")).alias("a"), key(F.col("merged_into_id")).alias("b")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


def p1_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = _groups(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_objects"))
    return sizes.groupBy("n_objects").agg(F.count(F.lit(1)).alias("n_groups"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return same_entities(load(spark, d, "vendor_master"), "LIFNR", "NAME1")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return surviving_rows(
        load(spark, d, "object_properties"), load(spark, d, "objects"), _groups(spark, d),
        load(spark, d, "property_catalog"), load(spark, d, "source_trust"),
    )


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(token_counts(load(spark, d, "documents"), "doc_id", "text"))
    return pack(sizes, load(spark, d, "pack_budgets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(token_counts(load(spark, d, "documents"), "doc_id", "text"))
    budgets = load(spark, d, "pack_budgets")
    return packing_report(cut(pack(sizes, budgets)), budgets)


def _leak_input(spark: SparkSession, d: str) -> tuple:
    # Any representative of a look-alike class will do here, so no frequencies are counted.
    rewriter = Rewriter(classes(look_alike_pairs(spark), {}))
    return load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "passage", rewriter


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(*_leak_input(spark, d))


def p9_leaks_per_suite(spark: SparkSession, d: str) -> DataFrame:
    suites = load(spark, d, "eval_items").select("item_id", "suite")
    hits = p9_found(spark, d).join(suites, "item_id")
    return hits.groupBy("suite").agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct("doc_id").alias("n_docs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return same_looking_pairs(load(spark, d, "documents"), "doc_id", "text")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """The compact form of p10_found: one row per document of a class."""
    return same_looking_classes(load(spark, d, "documents"), "doc_id", "text")


def p10_plain_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    plain = plain_texts(docs, "doc_id", "text", plain_form_rewriter(docs, "text"))
    return plain.select("doc_id", F.length("plain").alias("n_chars"), F.sha2("plain", 256).alias("plain_sha256"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_group_sizes, p2_found, p6_found, p8_containers, p8_report, p9_found, p9_leaks_per_suite, p10_found, p10_classes, p10_plain_texts)
}
