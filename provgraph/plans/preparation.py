"""Queries of the data-preparation operators over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.functions.text import key, number_key
from provgraph.operators import multivalue, property_table, references, row_parse
from provgraph.runtime import load

VENDOR_ROW = [
    row_parse.RowField("LIFNR"),
    row_parse.RowField("NAME1"),
    row_parse.RowField("LAND1", nullable=True),
    row_parse.RowField("TIER"),
    row_parse.RowField("DUNS", nullable=True),
    row_parse.number_field("QUALITY_RATING", "invalid_quality_rating"),
    row_parse.RowField("CERTIFICATIONS", nullable=True),
]
MATERIAL_ROW = [
    row_parse.alnum_field("MATNR", "invalid_matnr"),
    row_parse.RowField("MAKTX"),
    row_parse.enum_field("CLASS", "invalid_class", ["DIRECT_MATERIAL", "COMPONENT", "SUBASSEMBLY"]),
    row_parse.RowField("CRITICALITY"),
    row_parse.number_field("UNIT_COST", "invalid_unit_cost", not_negative=True),
]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    col = F.col
    parents = [
        references.parent_keys("vendor", load(spark, d, "vendor_master"), number_key(col("LIFNR")), col("loaded_at"), col("deleted_at")),
        references.parent_keys("material", load(spark, d, "material_master"), key(col("MATNR")), col("loaded_at"), col("deleted_at")),
        references.parent_keys("device", load(spark, d, "device_master"), key(col("DEVICE_ID")), col("loaded_at"), col("deleted_at")),
        references.parent_keys("object", load(spark, d, "objects"), key(col("id")), col("created_at")),
    ]
    supply, bom, links = (load(spark, d, t) for t in ("supply_relationship", "device_bom", "links"))
    child = references.child_keys
    children = [
        child("supply_relationship", "LIFNR", "vendor", supply, number_key(col("LIFNR")), col("line_no"), col("loaded_at")),
        child("supply_relationship", "MATNR", "material", supply, key(col("MATNR")), col("line_no"), col("loaded_at")),
        child("device_bom", "DEVICE_ID", "device", bom, key(col("DEVICE_ID")), col("line_no"), col("loaded_at")),
        child("links", "to_id", "object", links, key(col("to_id")), col("id"), col("created_at")),
    ]
    return references.failing_references(parents, children)


def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    return references.failures_by_period(p3_found(spark, d))


def _parsed(spark: SparkSession, d: str, table: str) -> DataFrame:
    schema = VENDOR_ROW if table == "vendor_raw" else MATERIAL_ROW
    return row_parse.parse_rows(load(spark, d, table), "raw_line", schema)


def _p4_rejects(spark: SparkSession, d: str) -> DataFrame:
    sides = [
        row_parse.rejects(_parsed(spark, d, raw), ["line_no"]).withColumn("src_table", F.lit(name))
        for raw, name in (("vendor_raw", "vendor_master"), ("material_raw", "material_master"))
    ]
    return sides[0].unionByName(sides[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4_rejects(spark, d).select("src_table", "line_no", "reason")


def p4_first_broken_field(spark: SparkSession, d: str) -> DataFrame:
    return _p4_rejects(spark, d).groupBy("src_table", "reason", "broken_field").agg(F.count(F.lit(1)).alias("n_rows"))


def p4_loaded_vendors(spark: SparkSession, d: str) -> DataFrame:
    return row_parse.loaded(_parsed(spark, d, "vendor_raw"), "raw_line", VENDOR_ROW, ["line_no"])


def p4_loaded_materials(spark: SparkSession, d: str) -> DataFrame:
    return row_parse.loaded(_parsed(spark, d, "material_raw"), "raw_line", MATERIAL_ROW, ["line_no"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "vendor_master").select("line_no", "CERTIFICATIONS")
    return multivalue.explode_values(rows, "CERTIFICATIONS", ["line_no"], "cert")


def p5_per_certificate(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("cert").agg(F.count(F.lit(1)).alias("n_rows"), F.max("pos").alias("max_pos"))


def typed(spark: SparkSession, d: str) -> DataFrame:
    return property_table.typed_properties(
        load(spark, d, "object_properties"), load(spark, d, "objects"), load(spark, d, "property_catalog")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return typed(spark, d).where(F.col("state") == "unreadable").select("prop_row_id")


def p7_wide(spark: SparkSession, d: str) -> DataFrame:
    rows = property_table.catalog_columns(load(spark, d, "property_catalog"))
    wide = property_table.wide_table(typed(spark, d), load(spark, d, "objects"), rows)
    lists = [n for n, _, multiple in rows if multiple]
    return wide.withColumns({n: F.to_json(n) for n in lists})


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_by_month, p4_found, p4_first_broken_field, p4_loaded_vendors, p4_loaded_materials,
        p5_found, p5_per_certificate, p7_found, p7_wide,
    )
}
