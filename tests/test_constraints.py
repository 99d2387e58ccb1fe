from decimal import Decimal

from pyspark.sql import functions as F

from provgraph.operators import constraints as C
from tests.conftest import day, rows
from tests.test_tracked import ROWS, prop


def broken(spark, data):
    return rows(C.broken_rules(spark.createDataFrame(data, ROWS), F.col("object_id"), C.property_rules()))


def test_property_rules(spark):
    def bad(i, **over):
        names = ROWS.replace("decimal(4,3)", "decimal").split(", ")
        row = dict(zip([n.split()[0] for n in names], prop(f"o{i}", "tier", 0, '"x"'), strict=True))
        return tuple((row | over).values())

    data = [
        bad(0), bad(1, confidence=Decimal("1.5")), bad(2, method="GUESS"), bad(3, verified_by="u", verified_at=day(0)), bad(4, verified_at=day(0)),
        bad(5, method="INFERRED"), bad(6, method="HUMAN_ENTRY"), bad(7, value="5"), bad(8, value_type="MAP"), bad(9, ordinal=-1), bad(10, property_name=" "), bad(11, confidence=None),
    ]
    assert broken(spark, data) == sorted([
        ("o1", "L1_confidence_range"), ("o2", "L2_method"), ("o3", "L4_verified_is_certain"), ("o4", "L5_verification_pair"),
        ("o5", "L8_record_unless_inferred"), ("o6", "L9_run_unless_human"), ("o7", "L3_value_type"), ("o8", "L3_value_type"),
        ("o9", "L7_property_key"), ("o10", "L7_property_key"), ("o11", "L1_confidence_range"),
    ], key=repr)


def test_links_and_objects(spark):
    o = spark.createDataFrame([("s", "SUPPLIER"), ("p", "PART"), ("x", "SHIP")], "id string, object_type string")
    lk = spark.createDataFrame([("1", "SUPPLIES", "s", "p"), ("2", "SUPPLIES", "p", "s"), ("3", "SUPPLIES", "s", "gone"), ("4", "SUPPLIES", "s", "p")], "id string, link_type string, from_id string, to_id string")
    assert rows(C.wrong_end_types(lk, o)) == [("2", "SUPPLIES", "PART", "SUPPLIER")]
    assert [r.id for r in C.missing_targets(lk, "to_id", o, "id").collect()] == ["3"]
    assert rows(C.repeated_keys(lk, ["link_type", "from_id", "to_id"])) == [("SUPPLIES", "s", "p", 2)]
    t = o.withColumns({"merged_into_id": F.when(F.col("id") == "s", "s"), "merged_at": F.lit(None).cast("timestamp")})
    assert rows(C.broken_rules(t, F.col("id"), C.object_rules())) == [("s", "L15_merge_pair"), ("s", "L15_merged_into_itself"), ("x", "L19_object_type")]


def test_cardinality(spark):
    o = spark.createDataFrame([("d", "DEVICE"), ("s", "SUPPLIER")], "id string, object_type string")
    data = [("d", n, 0) for n in ("deviceName", "deviceName", "productFamily", "regulatoryClass")] + [("s", "certifications", k) for k in (0, 2)]
    r = spark.createDataFrame(data, "object_id string, property_name string, ordinal int")
    got = rows(C.cardinality_breaks(r, o).where("object_id = 'd' or property_name = 'certifications'"))
    assert got == [("d", "deviceName", "several rows"), ("d", "lifecycleStage", "required missing"), ("s", "certifications", "ordinals not contiguous")]


def test_a_clean_graph_passes_every_check(spark):
    o = spark.createDataFrame([("v", "SITE", None, None), ("d", "DEVICE", None, None)], "id string, object_type string, merged_into_id string, merged_at timestamp")
    data = [prop("v", n, 0, '"x"') for n in ("siteName", "country", "siteType")]
    data += [prop("d", n, 0, '"x"') for n in ("deviceName", "productFamily", "regulatoryClass", "lifecycleStage")]
    r = spark.createDataFrame(data, ROWS)
    lk = r.limit(1).select(F.lit("l").alias("id"), F.lit("MANUFACTURED_AT").alias("link_type"), F.lit("d").alias("from_id"), F.lit("v").alias("to_id"), *[c for c in r.columns if c not in ("object_id", "property_name", "ordinal", "value", "value_type")])
    assert {n: rows(v) for n, v in C.graph_checks(o, r, lk).items()} == {n: [] for n in C.graph_checks(o, r, lk)}
    assert rows(C.graph_checks(o, r, lk.withColumn("to_id", F.lit("gone")))["L11_link_to"]) != []
