import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from provgraph.operators import apply as A
from provgraph.operators import ingest
from provgraph.sources import csv_bundle as B
from provgraph.store import ConstraintError, SnapshotStore
from tests.conftest import day, rows
from tests.test_ingest import FILES


def bundle(spark, folder, **changed):
    for name, lines in (FILES | changed).items():
        (folder / f"{name}.csv").write_text("\n".join([",".join(B.FILES[name]), *lines]))
    return B.read_bundle(spark, str(folder))


@pytest.fixture()
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def counts(store):
    return {name: store.read(name).count() for name in A.SCHEMAS}


def test_plans_are_applied_and_upserted(spark, tmp_path, store):
    A.apply_plan(store, ingest.Plan(bundle(spark, tmp_path)), "run-1", day(0))
    first = counts(store)
    assert first == {"objects": 5, "object_properties": 5 + 2 + 5 + 5 + 6 + 4, "links": 3, "object_source_keys": 5, "audit_records": 1, "audit_record_objects": 5, "ingestion_runs": 1}
    run = store.read("ingestion_runs").head()
    assert json.loads(run.summary)["accepted"]["vendors"] == 3 and run.audit_record_id == "audit-run-1" and run.finished_at is not None
    # A verified link keeps its verification, and confidence only goes down; a renamed vendor isn't refreshed.
    links = store.read("links").withColumns({"verified_by": F.lit("anna"), "verified_at": F.lit(day(1))})
    store.commit({"links": links})
    again = bundle(spark, tmp_path, supply_relationship=["100,M-1,0.9", "103,M-1,0.25"], vendor_master=["100,Other,FR,TIER_2,,1,", "103,X,DE,TIER_1,,1,", "105,New,DE,TIER_1,,1,"])
    A.apply_plan(store, ingest.Plan(again), "run-2", day(2))
    assert counts(store) == first | {"objects": 6, "object_properties": first["object_properties"] + 5, "object_source_keys": 6, "audit_records": 2, "audit_record_objects": 10, "ingestion_runs": 2}
    got = rows(store.read("links").where("link_type = 'SUPPLIES'").select("confidence", "pipeline_run_id", "verified_by"))
    assert got == [(Decimal("0.250"), "run-2", "anna"), (Decimal("0.500"), "run-2", "anna")]
    assert store.read("object_properties").where("value = '\"Acme GmbH\"'").count() == 1
    with pytest.raises(ValueError, match="run-2"):
        A.apply_plan(store, ingest.Plan(again), "run-2", day(3))
    store.prune()
    assert counts(store)["objects"] == 6


def test_an_empty_text_refuses_the_whole_plan(spark, tmp_path, store):
    plan = ingest.Plan(bundle(spark, tmp_path, vendor_master=["100,Acme,,TIER_1,,80,"]))
    with pytest.raises(ConstraintError):
        A.apply_plan(store, plan, "run-1", day(0))
    assert set(store.tables()) == {"ingestion_runs"} and store.read("ingestion_runs").head().summary == '{"phase":"running"}'


def test_graphs_are_inserted_whole_or_not_at_all(spark, tmp_path, store):
    plan = ingest.Plan(bundle(spark, tmp_path))
    wides = {kind: plan.tracked_objects(kind, "run-1", day(0)) for kind in ("SUPPLIER", "PART", "DEVICE")}
    links = plan.links().withColumns({"method": F.lit("DIRECT"), "pipeline_run_id": F.lit("run-1"), "extracted_at": F.lit(day(0))})
    A.insert_graph(store, wides, links, "a-1", day(0))
    assert store.read("objects").count() == 5 and store.read("audit_record_objects").count() == 5
    with pytest.raises(ConstraintError):
        A.insert_graph(store, wides, links, "a-2", day(1))
    assert store.read("audit_records").count() == 1


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    for f in range(2):
        lines = ["p,q", *("" if i % 7 == 3 else f'{f}-{i},"x, {i}"' for i in range(300))]
        (tmp_path / f"{f}.csv").write_text("\r\n".join(lines) + "\r\n", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        df = B.read_csv_rows(spark, str(tmp_path), ["p", "q"])
        assert df.rdd.getNumPartitions() > 8
        got = rows(df)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = []
    for f in range(2):
        kept = [i for i in range(300) if i % 7 != 3]
        want += [(k + 2, f"{f}-{i}", f"x, {i}") for k, i in enumerate(kept)]
    assert got == sorted(want, key=repr)


def test_manifests(spark, tmp_path):
    good = {"version": 1, "expectedDataQuality": {"rejectsByCode": {"VENDOR_MISSING_NAME": 3}, "skippedLinksByCode": {"BOM_ORPHAN_PART": 2}}, "rowCounts": {"vendors": 5}}
    (tmp_path / "manifest.json").write_text(json.dumps(good))
    assert B.expected_tallies(B.read_manifest(str(tmp_path))) == {"VENDOR_MISSING_NAME": 3, "BOM_ORPHAN_PART": 2}
    for wrong in ({"rejectsByCode": {"TYPO": 1}}, {"rejectsByCode": {"VENDOR_MISSING_NAME": -1}}, {"other": {}}):
        (tmp_path / "manifest.json").write_text(json.dumps(good | {"expectedDataQuality": wrong}))
        with pytest.raises(ValueError):
            B.read_manifest(str(tmp_path))


def test_csv_keeps_blanks(spark, tmp_path):
    df = spark.createDataFrame([("  a ", None), ('"', "x,\ty")], "p string, q string")
    B.write_csv(df.coalesce(1), str(tmp_path / "out"))
    assert [tuple(r)[1:] for r in B.read_csv_rows(spark, str(tmp_path / "out"), ["p", "q"]).orderBy("line").collect()] == [("  a ", ""), ('"', "x,\ty")]
