from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from provgraph import model
from provgraph.operators import constraints as C
from provgraph.operators import tracked
from provgraph.store import states_of
from tests.conftest import day, rows

AUDIT = "id string, actor_type string, status string, approved_by string, approved_at timestamp, approver_type string"


def broken(df, rules):
    return {tuple(r) for r in C.broken_rules(df, F.col("id"), rules).collect()}


def test_audit_rules(spark):
    df = spark.createDataFrame([
        ("fine", "HUMAN", "EXECUTED", "anna", day(0), "HUMAN"), ("open", "AGENT", "PROPOSED", None, None, None), ("pair", "HUMAN", "EXECUTED", "anna", None, "HUMAN"),
        ("early", "HUMAN", "PROPOSED", "anna", day(0), "HUMAN"), ("nobody", "HUMAN", "APPROVED", None, None, None), ("alone", "AGENT", "EXECUTED", None, None, None),
        ("agent", "HUMAN", "EXECUTED", "bot", day(0), "AGENT"), ("null", None, None, None, None, None),
    ], AUDIT)
    assert broken(df, C.audit_rules()) == {
        ("pair", "L12_approval_pair"), ("early", "L12_approver_without_approval"), ("nobody", "L12_approved_by_nobody"), ("alone", "L13_agent_executed_alone"),
        ("agent", "L13_approver_is_no_human"), ("null", "L19_actor_type"), ("null", "L19_audit_status"),
    }
    assert broken(df.where("false"), C.audit_rules()) == set()


def test_other_rules(spark):
    versions = spark.createDataFrame([("a", "[]", "[1]", "MIGRATION", None), ("b", "{}", None, "AGENT_PROPOSAL", None), ("c", "[x", " [] ", "HAND", "x")], "id string, object_types string, link_types string, applied_via string, audit_record_id string")
    assert broken(versions, C.schema_version_rules()) == {("b", "L14_agent_change_unaudited"), ("b", "L14_object_types_no_array"), ("b", "L14_link_types_no_array"), ("c", "L14_object_types_no_array"), ("c", "L19_applied_via")}
    runs = spark.createDataFrame([("r", day(1), day(0)), ("s", day(0), None), ("", day(0), day(0))], "id string, started_at timestamp, finished_at timestamp")
    assert broken(runs, C.run_rules()) == {("r", "L17_finished_before_start"), ("", "L17_run_id")}
    keys = spark.createDataFrame([("k", " ", "1"), ("l", "S", None)], "id string, source_system string, source_key string")
    assert broken(keys, C.source_key_rules()) == {("k", "L19_source_system"), ("l", "L19_source_key")}
    schema = "id string, survivor_id string, duplicate_id string, score double, status string, resolved_at timestamp, resolution_audit_id string"
    proposals = spark.createDataFrame([("p", "a", "a", 2.0, "PENDING", None, None), ("q", "a", "b", 0.5, "PENDING", day(0), None), ("r", "c", "b", 0.5, "CONFIRMED", None, None), ("s", "c", "b", 0.5, "PENDING", None, None)], schema)
    assert broken(proposals, C.proposal_rules()) == {("p", "L1_score_range"), ("p", "L16_merged_with_itself"), ("q", "L16_resolved_pair"), ("r", "L16_resolved_pair")}
    assert rows(C.pending_twice(proposals)) == [("b", 2)]
    assert rows(C.unaddressed_audits(runs, spark.createDataFrame([("r",)], "audit_record_id string"))) == [("",), ("s",)]


def test_declared_values_and_types(spark):
    typed = spark.createDataFrame([(1, "SUPPLIER", "tier", "TIER_9", None), (2, "SUPPLIER", "tier", "TIER_1", None), (3, "PART", "unitCost", "-1", -1.0), (4, "SITE", "siteName", "", None), (5, "SITE", "unknown", "x", None)], "prop_row_id long, object_type string, property string, text string, num double")
    assert rows(C.value_breaks(typed).select("prop_row_id", "problem")) == [(1, "not in the closed list"), (3, "below the minimum"), (4, "empty")]
    objects = spark.createDataFrame([(" A ", "SITE")], "id string, object_type string")
    props = spark.createDataFrame([("a", "siteName", 0, "NUMBER"), ("a", "tier", 0, "STRING"), ("A", "country", 0, "STRING"), (None, "tier", 0, "STRING")], "object_id string, property_name string, ordinal int, value_type string")
    assert rows(C.declared_type_breaks(props, objects).select("property_name", "problem")) == [("siteName", "another value type"), ("tier", "not declared")]


@pytest.mark.parametrize("hot", [True, False])
def test_references(spark, request, hot):
    if hot:
        request.getfixturevalue("salting")
    refs = spark.createDataFrame([("1", "a"), ("2", "z"), ("3", "z"), ("4", None), ("3", "z")], "id string, to_id string")
    found = C.broken_references({"links": refs, "objects": spark.createDataFrame([("a",), (None,)], "id string")}, [("links", "to_id", "id", "objects", "id")])
    assert rows(found) == [("links.to_id", "2", "z"), ("links.to_id", "3", "z"), ("links.to_id", "3", "z")]


def test_end_types_compare_ids_as_keys(spark):
    objects = spark.createDataFrame([("S", "SUPPLIER"), ("P", "PART")], "id string, object_type string")
    links = spark.createDataFrame([("1", "SUPPLIES", "s", " P "), ("2", "SUPPLIES", "p", "S"), ("3", "SUPPLIES", "s", "gone")], "id string, link_type string, from_id string, to_id string")
    assert rows(C.wrong_end_types(links, objects)) == [("2", "SUPPLIES", "PART", "SUPPLIER")]


def test_upserts_keep_verification_and_identity(spark):
    schema = "id string, link_type string, from_id string, to_id string, confidence decimal(4,3), method string, verified_by string, seq long"
    old = spark.createDataFrame([("1", "S", "a", "b", Decimal("1"), "DIRECT", "anna", 1)], schema)
    new = spark.createDataFrame([("2", "S", "a", "b", Decimal("0.7"), "INFERRED", None, 2), ("3", "S", "a", "c", Decimal("0.5"), "DIRECT", "bea", 2)], schema)
    want = [("S", "a", "b", Decimal("0.700"), 2, "1", "anna", "INFERRED"), ("S", "a", "c", Decimal("0.500"), 2, "3", "bea", "DIRECT")]
    columns = ["link_type", "from_id", "to_id", "confidence", "seq", "id", "verified_by", "method"]
    once = tracked.least_upsert(old, new)
    assert rows(once.select(*columns)) == rows(tracked.least_upsert(once, new).select(*columns)) == want


def test_states_and_names(spark):
    base = spark.createDataFrame([("s", "tier", 0, '"A"'), ("s", "status", 0, '"X"'), ("s", "tier", 1, '"B"')], "object_id string, property_name string, ordinal int, value string")
    changes = spark.createDataFrame([("s", "tier", '"C"'), ("s", "status", '"Y"')], "object_id string, property_name string, value string")
    assert rows(states_of(base, changes)) == [("s", '{"status":"X","tier":"A"}', '{"status":"Y","tier":"C"}')]
    assert list(model.class_definitions()) == ["Supplier", "Part", "Device", "Site", "QualityEvent"]
