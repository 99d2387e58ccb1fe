"""The registered queries do the whole job: all types, all properties, all values."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from provgraph import model
from tests.conftest import DATA

TINY = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TINY), reason="no test data")


def test_round_trip_of_all_types_and_lists(spark):
    got = entry.queries()["b7_explode_all_types"](spark, TINY).collect()
    assert {r.object_type for r in got} == set(model.OBJECT_TYPES)
    assert {r.value_type for r in got} == set(model.VALUE_TYPES)
    lists = {p.name for t in model.OBJECT_TYPES.values() for p in t.properties if p.multiple}
    assert {r.property_name for r in got if r.ordinal > 0} <= lists and max(r.ordinal for r in got) > 0


def test_upsert_updates_keys_across_runs(spark):
    line = spark.read.parquet(f"{TINY}/lineitem.parquet")
    keys = line.groupBy("l_suppkey", F.col("l_partkey") % 25).agg(F.bool_or(F.col("l_returnflag") == "N").alias("new"), F.bool_or(F.col("l_returnflag") != "N").alias("old"))
    got = entry.queries()["d7_least_upsert_overlap"](spark, TINY)
    assert got.count() == keys.count() and keys.where("old and new").count() > 0.9 * keys.count()
    # The newer run's evidence is taken, the least confidence of both.
    assert got.where(F.col("source_record_id").startswith("run-1:")).count() == keys.where("new").count()


def test_all_types_are_assembled_with_all_properties(spark):
    got = entry.queries()["b1_assemble_all_types"](spark, TINY)
    names = {f"{t.name}_{p.name}" for t in model.OBJECT_TYPES.values() for p in t.properties}
    assert names | {f"{n}_confidence" for n in names} | {"object_type", "id"} == set(got.columns)
    found = got.collect()
    assert {r.object_type for r in found} == set(model.OBJECT_TYPES)
    assert any(r.SUPPLIER_aliases not in (None, "[]") for r in found) and all(r.SUPPLIER_mergedFrom is not None for r in found if r.object_type == "SUPPLIER")


def test_missing_references_of_all_fields(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("objects", [("a",), ("b",)], "id string")
    write("links", [("l1", "x", "a"), ("l2", "a", "y"), ("l3", "a", "b"), ("l4", None, "b")], "id string, from_id string, to_id string")
    write("object_properties", [(1, "a"), (2, "z"), (3, None)], "prop_row_id long, object_id string")
    got = sorted(tuple(r) for r in entry.queries()["l11_missing_references"](spark, str(tmp_path)).collect())
    assert got == [("links.from_id", "l1", "x"), ("links.to_id", "l2", "y"), ("object_properties.object_id", "2", "z")]
