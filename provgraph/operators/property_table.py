"""Entity-attribute-value rows: typed reading, unreadable rows, and one wide row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.functions.skew import hot_keys, salted_join
from provgraph.functions.text import NUMBER, key, name_key, squeeze
from provgraph.runtime import broadcast_if_small, bucketed

#: Catalogs of at most so many rows are broadcast; larger ones are joined by shuffle.
CATALOG_ROWS = 10_000

_PAD = r"[ \t\r\n]*+"
_JSON_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_JSON_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_TIME = (
    r"([0-9]{4})-?([0-9]{2})-?([0-9]{2})T([01][0-9]|2[0-3])(?::?([0-5][0-9])(?::?([0-5][0-9]|60)(?:[.,]([0-9]+))?)?)?"
    r"(Z|z|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9])?)"
)

SQL_TYPE = {"STRING": "string", "NUMBER": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}


def json_kind(c: Column) -> Column:
    """'string', 'number', 'boolean' or 'null' for a JSON scalar, 'other' for anything else."""
    return (
        F.when(c.rlike(rf"\A{_PAD}{_JSON_STRING}{_PAD}\z"), "string")
        .when(c.rlike(rf"\A{_PAD}{_JSON_NUMBER}{_PAD}\z"), "number")
        .when(c.rlike(rf"\A{_PAD}(?:true|false){_PAD}\z"), "boolean")
        .when(c.rlike(rf"\A{_PAD}null{_PAD}\z"), "null")
        .otherwise("other")
    )


def _timestamp(text: Column) -> Column:
    """An ISO 8601 date-time with offset, as a timestamp; null where the date doesn't exist."""
    g = lambda k: F.regexp_extract(text, rf"\A{_TIME}\z", k)
    or0 = lambda c: F.when(c == "", "00").otherwise(c)
    zone = F.regexp_replace(F.upper(g(8)), r"^([+-]..):?(..)?$", "$1:$2")
    zone = F.when(zone.endswith(":"), F.concat(zone, F.lit("00"))).otherwise(zone)
    iso = F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit("T"), g(4), F.lit(":"), or0(g(5)), F.lit(":"),
                   F.when(g(6) == "60", "59").otherwise(or0(g(6))), F.lit("."), F.substring(F.concat(g(7), F.lit("000000")), 1, 6), zone)
    return F.when(text.rlike(rf"\A{_TIME}\z"), iso.try_cast("timestamp"))


def typed_properties(
    props: DataFrame, objects: DataFrame, catalog: DataFrame, carry: tuple[str, ...] = ()
) -> DataFrame:
    """The rows of `props` whose property is declared for the type of their object, read as the
    declared type.

    Columns: prop_row_id, object_id (as `key`), object_type, property (as in the catalog),
    value_type, is_multiple, ordinal, the evidence columns, `text` (the decoded string, or the
    JSON text of a number or boolean), num, flag, at, and `state`:
    'empty' (null, JSON null, blank JSON string), 'unreadable' (no JSON, an array or object, or
    not of the type), 'ok'. An id with rows of several types counts as the smallest type name.
    Rows of unknown objects and undeclared properties don't come out. Repeated rows stay.
    `carry`: columns of `objects` (one value per id) that come out too.
    """
    types = objects.select(key(F.col("id")).alias("object_id"), "object_type", *carry)
    types = types.where(F.col("object_id").isNotNull()).groupBy("object_id")
    types = types.agg(*(F.min(c).alias(c) for c in ("object_type", *carry)))
    declared = catalog.select(
        "object_type", name_key(F.col("property_name")).alias("_name"), F.col("property_name").alias("property"),
        F.upper("value_type").alias("_declared"), "is_multiple",
    )
    rows = props.select(
        "prop_row_id", key(F.col("object_id")).alias("object_id"), name_key(F.col("property_name")).alias("_name"),
        "ordinal", "value", "confidence", "source_system", "extracted_at", "verified_by",
    )
    declared = broadcast_if_small(declared, CATALOG_ROWS)
    rows = salted_join(rows, types, ["object_id"], "prop_row_id", hot_keys(rows, ["object_id"]))
    rows = rows.join(declared, ["object_type", "_name"])
    kind = json_kind(F.col("value"))
    rows = rows.withColumn("_kind", kind)
    decoded = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
    text = F.when(F.col("_kind").isin("string", "number", "boolean"), decoded)
    raw = F.regexp_replace("value", r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")
    rows = rows.withColumn("text", F.when(F.col("_kind") == "string", text).when(F.col("_kind").isin("number", "boolean"), raw))
    # Columns that later ones use several times are made one by one, so that each is computed once.
    rows = rows.withColumn("_t", squeeze(F.col("text")))
    trimmed, declared_as = F.col("_t"), F.col("_declared")
    is_number = F.col("_kind").isin("string", "number") & trimmed.rlike(rf"\A{NUMBER}\z")
    is_flag = F.col("_kind").isin("string", "boolean") & F.lower(trimmed).isin("true", "false")
    rows = rows.withColumns(
        {
            "num": F.when((declared_as == "NUMBER") & is_number, trimmed.try_cast("double")),
            "flag": F.when((declared_as == "BOOLEAN") & is_flag, F.lower(trimmed) == "true"),
            "at": F.when((declared_as == "TIMESTAMP") & (F.col("_kind") == "string"), _timestamp(trimmed)),
        }
    )
    readable = (
        F.when(declared_as == "STRING", F.col("_kind").isin("string", "number", "boolean"))
        .when(declared_as == "NUMBER", F.col("num").isNotNull())
        .when(declared_as == "BOOLEAN", F.col("flag").isNotNull())
        .when(declared_as == "TIMESTAMP", F.col("at").isNotNull())
        .otherwise(F.lit(False))
    )
    state = (
        F.when(F.col("value").isNull() | (F.col("_kind") == "null"), "empty")
        .when((F.col("_kind") == "string") & (trimmed == ""), "empty")
        .when(readable, "ok")
        .otherwise("unreadable")
    )
    return rows.withColumn("state", state).select(
        "prop_row_id", "object_id", "object_type", "property", F.col("_declared").alias("value_type"), "is_multiple",
        "ordinal", "confidence", "source_system", "extracted_at", "verified_by", "text", "num", "flag", "at", "state", *carry,
    )


#: Objects per bucket of the narrow tables, and attributes joined in a row before chains are joined.
OBJECTS_PER_BUCKET, CHAIN = 100_000, 5


def catalog_columns(catalog: DataFrame) -> list[tuple[str, str, bool]]:
    """(property, value_type, is_multiple) for each property name of a catalog, those of one object type
    beside each other. The catalog is the schema of the wide table, so it must be known to plan.

    A name that object types declare with different types, or as a list and not, is a ValueError: one
    column can't hold both.
    """
    declared = catalog.groupBy("property_name").agg(
        F.min("object_type").alias("o"), F.collect_set(F.struct(F.upper("value_type").alias("t"), F.col("is_multiple").alias("m"))).alias("kinds")
    ).orderBy("o", "property_name").collect()
    conflicts = [r.property_name for r in declared if len(r.kinds) > 1]
    if conflicts:
        raise ValueError(f"declared differently by several object types: {', '.join(conflicts)}")
    return [(r.property_name, r.kinds[0].t, r.kinds[0].m) for r in declared]


def _narrow(kept: DataFrame, name: str, value_type: str, is_multiple: bool) -> DataFrame:
    """The typed table of one attribute: object_id (once, in order) and a column `name`."""
    value = F.col("values")[{"STRING": "text", "NUMBER": "num", "BOOLEAN": "flag", "TIMESTAMP": "at"}[value_type]]
    return kept.where(F.col("property") == name).select("object_id", (value if is_multiple else F.get(value, 0)).alias(name))


def _joined(ids: DataFrame, narrow: list[DataFrame]) -> DataFrame:
    """The narrow tables joined to the objects as a tree: chains of up to CHAIN attributes, then the chains.

    Every join has a table of all objects on its left, as a full outer join of two narrow tables would
    lose the partitioning; so all levels stay partitioned and sorted by object_id as the tables are
    stored, and the whole tree is one stage of merges without exchange or sort.
    """
    chains = []
    for at in range(0, len(narrow), CHAIN):
        chain = ids
        for table in narrow[at : at + CHAIN]:
            chain = chain.join(table.hint("merge"), "object_id", "left")
        chains.append(chain)
    while len(chains) > 1:
        pairs = [chains[i : i + 2] for i in range(0, len(chains), 2)]
        chains = [p[0].join(p[1].hint("merge"), "object_id", "left") if len(p) > 1 else p[0] for p in pairs]
    return chains[0] if chains else ids


def wide_table(typed: DataFrame, objects: DataFrame, catalog_rows: list[tuple[str, str, bool]]) -> DataFrame:
    """One row per object with a column of the declared type for each property.

    `catalog_rows`: see `catalog_columns`. For each (object, property, ordinal) the row with the highest
    confidence comes first, then the latest, then the smallest prop_row_id; a single-valued property
    takes the smallest ordinal (null last). Multiple ones are lists by ordinal (nulls last; every such
    value stays), null without values. Objects without any readable property have a row of nulls.
    The best rows are chosen by an aggregate that combines before the shuffle, and stored once,
    partitioned by attribute and bucketed by object; objects are bucketed alike. Each narrow table
    reads its own part only, and the joins need no further exchange.
    """
    multiple = F.col("property").isin([name for name, _, is_multiple in catalog_rows if is_multiple])
    # Of a single-valued property the smallest ordinal comes first; of a list each has its own row,
    # and so has each row without an ordinal.
    slot = F.when(multiple, F.col("ordinal"))
    unplaced = F.when(multiple & F.col("ordinal").isNull(), F.col("prop_row_id"))
    order = F.struct(
        F.when(multiple, 0).otherwise(F.coalesce(-F.col("ordinal"), F.lit(-(2**31)))), F.coalesce("confidence", F.lit(-1)),
        F.coalesce(F.unix_micros("extracted_at"), F.lit(-(2**62))), -F.col("prop_row_id"),
    )
    best = (
        typed.where(F.col("state") == "ok")
        .groupBy("object_id", "property", slot.alias("ordinal"), unplaced.alias("_unplaced"))
        .agg(F.max_by(F.struct("prop_row_id", "text", "num", "flag", "at"), order).alias("v"))
    )
    ids = objects.select(key(F.col("id")).alias("object_id")).where(F.col("object_id").isNotNull())
    buckets = max(objects.sparkSession.sparkContext.defaultParallelism, -(-ids.count() // OBJECTS_PER_BUCKET))
    # Partitioned by object before rows become lists, so that the list is made where it is stored.
    listed = F.sort_array(F.collect_list(F.struct(F.col("ordinal").isNull().alias("_last"), "ordinal", "v")))
    kept = best.repartition(buckets, "object_id").groupBy("object_id", "property").agg(F.transform(listed, lambda x: x["v"]).alias("values"))
    ids = bucketed(ids.repartition(buckets, "object_id").distinct(), "object_id", buckets)
    kept = bucketed(kept, "object_id", buckets, by="property")
    return _joined(ids, [_narrow(kept, *row) for row in catalog_rows])
