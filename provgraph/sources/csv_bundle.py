"""Master-data CSV files: all-string schemas, line numbers, and manifest."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provgraph.operators.ingest import REJECT_CODES, SKIP_CODES
from provgraph.runtime import broadcast_if_small

# The columns of each file of a bundle.
FILES = {
    "vendor_master": ["LIFNR", "NAME1", "LAND1", "TIER", "DUNS", "QUALITY_RATING", "CERTIFICATIONS"],
    "material_master": ["MATNR", "MAKTX", "CLASS", "CRITICALITY", "UNIT_COST"],
    "device_master": ["DEVICE_ID", "DEVICE_NAME", "PRODUCT_FAMILY", "REG_CLASS", "LIFECYCLE"],
    "supply_relationship": ["LIFNR", "MATNR", "CONFIDENCE"],
    "device_bom": ["DEVICE_ID", "MATNR", "CONFIDENCE"],
}


#: Splits of a file are numbered by a broadcast up to so many of them.
SPLITS = 100_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 1 in each file without its blank lines.

    Files are read in splits, by as many tasks as they have: each split's lines are counted, and its
    lines are numbered from the number of lines before it. What is shuffled is a row per split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    # Ids are consecutive within a task; the first of a split is taken off.
    kept = lines.where(F.trim(F.regexp_replace("value", r"\r$", "")) != "").withColumn("_id", F.monotonically_increasing_id())
    splits = kept.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start")) - F.col("_n")
    splits = broadcast_if_small(splits.select("file", "_start", "_first", before.alias("_before")), SPLITS)
    joined = kept.join(splits, ["file", "_start"])
    return joined.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), F.regexp_replace("value", r"\r$", "").alias("value"))


def read_csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(line, *columns) of a CSV file with a header, or of a folder of such files: every column a string,
    '' for a missing cell; cells beyond the columns are left out.

    Blank lines don't count; the header is line 1 of its file. A header that differs from `columns`,
    and an input without any, are a ValueError. A quoted field doesn't go over a line's end.
    """
    numbered = numbered_lines(spark, path)
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    schema = ", ".join(f"`{c}` string" for c in columns)
    cells = lambda df: df.select("line", F.from_csv("value", schema, options).alias("r"), "value")
    heads = cells(numbered.where("line = 1")).select("r", "value").distinct().limit(2).collect()
    if not heads:
        raise ValueError(f"{path} is empty")
    for head in heads:
        if [str(h or "").strip() for h in head.r] != columns or head.value.count(",") != len(columns) - 1:
            raise ValueError(f"{path} has the columns {head.value}, expected {','.join(columns)}")
    return cells(numbered.where("line > 1")).select("line", *(F.coalesce(F.col("r")[c], F.lit("")).alias(c) for c in columns))


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_csv_rows(spark, os.path.join(folder, f"{name}.csv"), columns) for name, columns in FILES.items()}


# The keys of a manifest, and of its parts that are checked.
_MANIFEST_KEYS = {"version", "fixtureId", "description", "expectedDataQuality", "expectedMergeClusters", "expectedNonMergePairs", "demoRoles", "rowCounts"}
_QUALITY_KEYS = {"rejectsByCode": set(REJECT_CODES), "skippedLinksByCode": set(SKIP_CODES)}


def read_manifest(folder: str) -> dict:
    """The manifest of a bundle. Unknown keys, unknown codes and tallies that are no whole numbers from 0 on
    are a ValueError."""
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)

    def known(part: dict, keys: set[str], name: str) -> None:
        if not isinstance(part, dict) or set(part) - keys:
            raise ValueError(f"unknown keys in {name}: {sorted(set(part) - keys) if isinstance(part, dict) else part}")

    def counts(part: dict, name: str) -> None:
        wrong = [k for k, n in part.items() if isinstance(n, bool) or not isinstance(n, int) or n < 0]
        if wrong:
            raise ValueError(f"no counts in {name}: {wrong}")

    known(manifest, _MANIFEST_KEYS, "manifest")
    quality = manifest.get("expectedDataQuality", {})
    known(quality, set(_QUALITY_KEYS), "expectedDataQuality")
    for name, tallies in quality.items():
        known(tallies, _QUALITY_KEYS[name], name)
        counts(tallies, name)
    if "rowCounts" in manifest:
        counts(manifest["rowCounts"], "rowCounts")
    return manifest


def expected_tallies(manifest: dict) -> dict[str, int]:
    """All tallies a manifest names, by code."""
    return {code: n for part in manifest.get("expectedDataQuality", {}).values() for code, n in part.items()}


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180: a header, quotes only where needed, doubled quotes inside, blanks as they are, '' for null."""
    options = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode("overwrite").options(**options).csv(path, header=True)
