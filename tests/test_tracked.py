from decimal import Decimal

from pyspark.sql import functions as F

from provgraph import model
from provgraph.operators import tracked as T
from tests.conftest import day, rows


def prop(o, name, ordinal, value, kind="STRING", conf="0.9", run="r1", by=None):
    return (o, name, ordinal, value, kind, Decimal(conf), "SAP", "rec", run, day(0), "DIRECT", by, day(1) if by else None)


ROWS = ", ".join(f"{c} {t}" for c, t in zip(T.ROW_COLUMNS, ["string", "string", "int", "string", "string", "decimal(4,3)", "string", "string", "string", "timestamp", "string", "string", "timestamp"], strict=True))


def test_round_trip(spark):
    data = [prop("s1", "legalName", 0, '"A \\"x\\" é"'), prop("s1", "qualityRating", 0, "80.5", "NUMBER"), prop("s1", "certifications", 0, '"ISO 9001"'),
            prop("s1", "certifications", 1, '"ISO 13485"', conf="1.0", by="u"), prop("s2", "legalName", 0, '"B"')]
    r = spark.createDataFrame(data, ROWS)
    o = spark.createDataFrame([("s1", "SUPPLIER"), ("s2", "SUPPLIER"), ("s3", "SUPPLIER"), ("p", "PART")], "id string, object_type string")
    wide = T.assemble_objects(r, o, "SUPPLIER")
    assert [(f.name, f.dataType) for f in wide.schema.fields if f.name == "legalName"][0][1]["value"].dataType == model.wide_schema("SUPPLIER")["legalName"].dataType["value"].dataType
    got = {x.id: x for x in wide.collect()}
    assert got["s1"].legalName.value == 'A "x" é' and got["s1"].legalName.confidence == Decimal("0.900")
    assert [c.value for c in got["s1"].certifications] == ["ISO 9001", "ISO 13485"]
    assert got["s1"].certifications[1].verification.by == "u" and got["s1"].certifications[0].verification is None
    assert got["s2"].certifications == [] and got["s2"].duns is None and got["s3"].legalName is None and "p" not in got
    assert rows(T.explode_objects(wide, "SUPPLIER")) == rows(r)


def links(spark):
    data = [("l1", "SUPPLIES", "a", "p", Decimal("0.3"), "SAP", "r1", "DIRECT", None), ("l2", "COMPOSED_OF", "d", "p", Decimal("1"), "SAP", "r2", "DIRECT", "u")]
    return spark.createDataFrame(data, "id string, link_type string, from_id string, to_id string, confidence decimal(4,3), source_system string, pipeline_run_id string, method string, verified_by string")


def test_lookups(spark):
    lk = links(spark)
    assert [r.id for r in T.links_of(lk, "p").collect()] == ["l1", "l2"]
    assert [r.id for r in T.links_of(lk, "p", "SUPPLIES").collect()] == ["l1"]
    assert T.links_of(lk, "nobody").collect() == []
    assert rows(T.adjacency(lk).select("node", "direction", "other")) == [("a", "ALONG", "p"), ("d", "ALONG", "p"), ("p", "AGAINST", "a"), ("p", "AGAINST", "d")]
    r = spark.createDataFrame([prop("s", "duns", 0, '"1"', conf="0.4"), prop("s", "tier", 0, '"x"', conf="0.2", by="u")], ROWS)
    assert [x.fact_key for x in T.review_queue(r, lk, 0.5).collect()] == ["l1", "s|duns|0"]
    assert sorted(x.fact_key for x in T.touched_by_run(r, lk, "r1").collect()) == ["l1", "s|duns|0", "s|tier|0"]
    assert ("link", "DIRECT", 2, 0.65, 1) in rows(T.calibration(r, lk))
    assert [x.property_name for x in T.property_rows(r, "s").collect()] == ["duns", "tier"]


def test_least_upsert_keeps_the_least_and_the_newest(spark):
    schema = "link_type string, from_id string, to_id string, confidence decimal(4,3), run string, seq int"
    old = spark.createDataFrame([("S", "a", "b", Decimal("0.5"), "one", 1)], schema)
    new = spark.createDataFrame([("S", "a", "b", Decimal("0.9"), "two", 2), ("S", "a", "c", Decimal("0.7"), "two", 2)], schema)
    once = T.least_upsert(old, new)
    assert rows(once.select("to_id", "confidence", "run")) == [("b", Decimal("0.500"), "two"), ("c", Decimal("0.700"), "two")]
    assert rows(T.least_upsert(once, new)) == rows(once)


def test_insert_absent_never_refreshes(spark):
    table = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string")
    once = T.insert_absent(table, new, ["k"])
    assert rows(once) == [(1, "old"), (2, "a")] and rows(T.insert_absent(once, new, ["k"])) == rows(once)


def test_resolution_is_one_hop(spark):
    keys = spark.createDataFrame([("S", "1", "a"), ("S", "2", "b")], "source_system string, source_key string, object_id string")
    objects = spark.createDataFrame([("a", "b"), ("b", None)], "id string, merged_into_id string")
    assert rows(T.resolve_sources(keys, objects)) == [("S", "1", "b"), ("S", "2", "b")]


def test_differences(spark):
    a, b = (spark.createDataFrame(x, "v int") for x in ([(1,), (1,), (2,)], [(1,), (3,)]))
    assert rows(T.differences(a, b)) == [(1, "left"), (2, "left"), (3, "right")]
    assert T.differences(a, a).where(F.lit(True)).count() == 0
