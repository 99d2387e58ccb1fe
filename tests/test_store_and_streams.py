from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from provgraph.operators import constraints
from provgraph.operators.tracked import least_upsert
from provgraph.store import ConstraintError, SnapshotStore, audit_history, ingestion_run, update_values
from provgraph.streaming.upserts import confidence_by_window, upsert_links
from tests.conftest import day, rows

LINK = "link_type string, from_id string, to_id string, confidence decimal(4,3), run string"


def test_commits_are_whole_and_gated(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    links = spark.createDataFrame([("S", "a", "b", Decimal("0.5"), "r")], LINK)
    assert store.tables() == {} and store.commit({"links": links}) == 1
    bad = spark.createDataFrame([("S", "a", "a", Decimal("0.5"), "r")], LINK)
    rule = {"self": F.col("from_id") == F.col("to_id")}
    with pytest.raises(ConstraintError):
        store.commit({"links": bad}, [constraints.broken_rules(bad, F.col("from_id"), rule)])
    assert rows(store.read("links")) == rows(links)
    assert store.commit({"links": store.read("links").unionByName(links)}, [constraints.broken_rules(links, F.col("from_id"), rule)]) == 2
    assert store.read("links").count() == 2
    store.empty(["links"])
    assert store.read("links").columns == links.columns and store.read("links").count() == 0


def test_streamed_upserts(spark, tmp_path):
    source, store = str(tmp_path / "in"), SnapshotStore(spark, str(tmp_path / "s"))
    for conf, run in (("0.6", "one"), ("0.9", "two")):
        spark.createDataFrame([("S", "a", "b", Decimal(conf), run)], LINK).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LINK).parquet(source)
        upsert_links(stream, store, str(tmp_path / "c")).awaitTermination()
    assert rows(store.read("links").select("confidence", "run")) == [(Decimal("0.600"), "two")]


def test_upserts_write_the_buckets_they_touch(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    link = lambda *pairs: spark.createDataFrame([("S", f"a{i}", "b", Decimal(c), "r", 0) for i, c in pairs], LINK + ", seq long")
    keys = ["link_type", "from_id", "to_id"]
    store.commit({"links": link((0, "0.9"))})  # a plain table is taken over
    store.upsert("links", link(*((i, "0.9") for i in range(1, 40))), keys, least_upsert, 8)
    before = store._state()["buckets"]["links"]
    store.upsert("links", link((3, "0.5")), keys, least_upsert)
    after = store._state()["buckets"]["links"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 9
    assert store.read("links").count() == 40 and store.read("links").where("confidence = 0.5").count() == 1
    store.upsert("links", link(), keys, least_upsert)
    store.prune()
    assert store.read("links").count() == 40
    store.commit({"links": link((1, "1"))})  # and becomes a plain one again
    assert store.read("links").count() == 1
    store.prune()
    assert store.read("links").count() == 1


def test_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("S", Decimal("0.5"), day(0)), ("S", Decimal("0.3"), day(0)), ("S", Decimal("0.9"), day(5))], "link_type string, confidence decimal(4,3), at timestamp").write.parquet(source)
    stream = spark.readStream.schema("link_type string, confidence decimal(4,3), at timestamp").parquet(source)
    q = confidence_by_window(stream, "at", "1 day", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("w").select("n_links", "least_confidence")) == [(1, Decimal("0.900")), (2, Decimal("0.300"))]


def test_audits_and_runs(spark):
    audits = spark.createDataFrame([("2", day(1)), ("1", day(1)), ("3", day(0))], "id string, proposed_at timestamp")
    addressed = spark.createDataFrame([("1", "o"), ("2", "o"), ("3", "p"), ("1", "o")], "audit_record_id string, object_id string")
    assert [r.id for r in audit_history(audits, addressed, "o").collect()] == ["1", "2"]
    tallies = spark.createDataFrame([("B", 0), ("A", 2)], "code string, n long")
    assert ingestion_run(spark, "r", tallies, day(0), day(1)).head().summary == '{"A":2,"B":0}'


def test_updates(spark):
    base = spark.createDataFrame([("s", "status", 0, '"A"', Decimal("0.5"), "DIRECT"), ("s", "tier", 0, '"T"', Decimal("0.5"), "DIRECT")], "object_id string, property_name string, ordinal int, value string, confidence decimal(4,3), method string")
    change = spark.createDataFrame([("s", "status", '"B"')], "object_id string, property_name string, value string")
    assert rows(update_values(base, change, day(0), "audit"))[0] == ("s", "status", 0, '"B"', Decimal("1.000"), "HUMAN_ENTRY")
    with pytest.raises(ValueError):
        update_values(base, change, day(0), "audit", ["status"], source="INGEST")
    with pytest.raises(ValueError):
        update_values(base, change.withColumn("object_id", F.lit("x")), day(0), "audit")
