"""Best representative of each duplicate group: field-by-field survivorship.

One aggregation takes, for each group and property, the maximum of a composite struct; it is
combined before the shuffle, so a group of any size costs one row per task and property.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.functions.text import is_blank, key, squeeze
from provgraph.operators.property_table import typed_properties
from provgraph.runtime import broadcast_if_small

# Texts that stand for "not known", compared squeezed and in lower case, without
# surrounding punctuation where something else remains.
STAND_INS = [
    "n/a", "n.a.", "n.a", "na", "nan", "nil", "none", "null", "not known", "not available", "not applicable",
    "unknown", "unk", "unspecified", "undefined", "tbd", "tbc", "tba", "to be determined", "to be defined",
    "?", "??", "???", "-", "--", "---", "_", ".", "..", "...", "x", "xx", "xxx", "*", "#", "#n/a", "k.a.",
    "unbekannt", "not set", "empty", "missing", "no data", "keine angabe",
]

#: A trust table of at most so many rows is broadcast.
TRUST_ROWS = 10_000


def _source(c):
    """Source names are compared without regard to case, blanks and underscores alike."""
    return key(F.regexp_replace(c, "_", " "))


def surviving_rows(
    props: DataFrame, objects: DataFrame, groups: DataFrame, catalog: DataFrame, trust: DataFrame
) -> DataFrame:
    """(group_id, property_name, prop_row_id) of the row to be kept, for each group and
    single-valued property with at least two usable rows.

    `groups` has (id, group_id); an object without a group is its own. A row is usable unless its
    value is empty, unreadable as the declared type, or (STRING) a stand-in for "not known".
    First comes a row that is verified, then higher confidence, later extraction, the more trusted
    source (smaller trust_rank), the smaller prop_row_id; nulls and unknown sources come last.
    """
    oid = key(F.col("id"))
    of_object = objects.select(oid.alias("id"), "object_type").distinct().join(groups.select("id", "group_id"), "id", "left")
    of_object = of_object.withColumn("group_id", F.coalesce("group_id", "id"))
    typed = typed_properties(props, of_object, catalog, carry=("group_id",))
    stand_in = (F.col("value_type") == "STRING") & F.lower(squeeze(F.col("text"))).isin(STAND_INS)
    usable = typed.where((F.col("state") == "ok") & ~F.col("is_multiple") & ~stand_in)
    ranks = trust.select(_source(F.col("source_system")).alias("_source"), F.col("trust_rank").alias("_rank"))
    ranks = ranks.where(F.col("_source").isNotNull()).groupBy("_source").agg(F.min("_rank").alias("_rank"))
    ranked = usable.withColumn("_source", _source(F.col("source_system"))).join(
        broadcast_if_small(ranks, TRUST_ROWS), "_source", "left"
    )
    # In a maximum null is the smallest value, so ascending criteria are negated.
    merit = F.struct(
        (~is_blank(F.col("verified_by"))).alias("verified"),
        F.col("confidence"),
        F.col("extracted_at"),
        (-F.col("_rank")).alias("trust"),
        (-F.col("prop_row_id")).alias("row"),
    )
    best = ranked.groupBy("group_id", F.col("property").alias("property_name")).agg(
        F.max(merit).alias("best"), F.count(F.lit(1)).alias("n_usable")
    )
    return best.where(F.col("n_usable") > 1).select("group_id", "property_name", (-F.col("best.row")).alias("prop_row_id"))
