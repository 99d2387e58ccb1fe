from decimal import Decimal

import pytest

from provgraph import model
from provgraph.operators import traverse as T
from tests.conftest import rows


def graph(spark, objects, links):
    o = spark.createDataFrame([(i, t, None) for t, ids in objects.items() for i in ids], "id string, object_type string, merged_into_id string")
    edges = [(f"l{k}", t, a, b, Decimal(str(c))) for k, (t, a, b, c) in enumerate(links)]
    return o, spark.createDataFrame(edges, "id string, link_type string, from_id string, to_id string, confidence decimal(4,3)")


CHAIN = (
    {"SUPPLIER": ["sup-1", "sup-2"], "PART": ["part-1", "part-2", "part-3"], "DEVICE": ["dev-1", "dev-2"]},
    [("SUPPLIES", "sup-1", "part-1", 0.9), ("SUPPLIES", "sup-1", "part-2", 0.5), ("SUPPLIES", "sup-2", "part-1", 0.6),
     ("COMPOSED_OF", "dev-1", "part-1", 0.8), ("COMPOSED_OF", "dev-1", "part-2", 0.95), ("COMPOSED_OF", "dev-2", "part-3", 1)],
)
BRIDGE = (
    {"SUPPLIER": ["helix", "other"], "PART": ["shared", "bridge"], "DEVICE": ["infusor", "only-bridge"]},
    [("SUPPLIES", "helix", "shared", 0.55), ("SUPPLIES", "other", "shared", 0.97), ("SUPPLIES", "other", "bridge", 0.96),
     ("COMPOSED_OF", "infusor", "shared", 0.92), ("COMPOSED_OF", "only-bridge", "bridge", 0.93)],
)
RISK = model.SUPPLIER_DEVICE_RISK


def found(spark, case, source):
    o, links = graph(spark, *case)
    return [(r.target_id, float(r.confidence), r.path_count, r.n1, r.weakest_step) for r in T.traverse(links, o, RISK, source).collect()]


def test_weakest_link_and_count(spark):
    assert found(spark, CHAIN, "sup-1") == [("dev-1", 0.8, 2, "part-1", 1)]


def test_a_path_does_not_cross_a_part_of_another_supplier(spark):
    assert found(spark, BRIDGE, "helix") == [("infusor", 0.55, 1, "shared", 0)]
    assert [f[:2] for f in found(spark, BRIDGE, "other")] == [("only-bridge", 0.93), ("infusor", 0.92)]


def test_ties_by_signature_not_by_id(spark):
    objects = {"SUPPLIER": ["s"], "PART": ["p-1", "p-10"], "DEVICE": ["d"]}
    links = [(t, a, p, 0.5) for p in ("p-1", "p-10") for t, a in (("SUPPLIES", "s"), ("COMPOSED_OF", "d"))]
    assert found(spark, (objects, links), "s") == [("d", 0.5, 2, "p-10", 0)]


def test_unknown_is_not_empty(spark):
    o, links = graph(spark, *CHAIN)
    with pytest.raises(T.UnknownObject):
        T.traverse(links, o, RISK, "nobody")
    with pytest.raises(T.UnknownObject):
        T.traverse(links, o, RISK, "part-1")
    assert T.traverse(links.where("false"), o, RISK, "sup-1").collect() == []


def test_merged_objects_are_refused_where_asked(spark):
    o = spark.createDataFrame([("a", "PART", "b")], "id string, object_type string, merged_into_id string")
    T.require_object(o, "a", "PART")
    with pytest.raises(T.MergedObject):
        T.require_object(o, "a", "PART", refuse_merged=True)
    with pytest.raises(T.UnknownObject):
        T.require_object(o, "a", "DEVICE", refuse_merged=True)


def test_bottleneck_equals_paths(spark):
    o, links = graph(spark, *BRIDGE)
    a = T.target_scores(T.paths(links, o, RISK), RISK).select("source_id", "target_id", "confidence", "path_count")
    assert rows(T.bottleneck_scores(links, RISK).select(*a.columns)) == rows(a)


def test_walks_end_elsewhere_than_they_start(spark):
    o, links = graph(spark, *BRIDGE)
    got = rows(T.target_scores(T.paths(links, o, model.CO_SUPPLIERS), model.CO_SUPPLIERS).select("source_id", "target_id"))
    assert got == [("helix", "other"), ("other", "helix")]


def test_shared_prefix(spark):
    objects = {"SUPPLIER": ["s"], "PART": ["p"], "DEVICE": ["d1", "d2"]}
    links = [("SUPPLIES", "s", "p", 0.5), ("COMPOSED_OF", "d1", "p", 0.6), ("COMPOSED_OF", "d2", "p", 0.7)]
    o, links = graph(spark, objects, links)
    assert rows(T.shared_prefix(T.best_paths(T.paths(links, o, RISK), RISK), RISK)) == [("s", 2, 1, True)]


def test_profiles_are_checked():
    for p in model.PROFILES.values():
        assert model.check_profile(p) == p.to
    with pytest.raises(ValueError):
        model.check_profile(model.Profile((), "PART"), "PART")
    with pytest.raises(ValueError):
        model.check_profile(model.Profile((model.Step("SUPPLIES"), model.Step("SUPPLIES")), "PART"))
    with pytest.raises(ValueError):
        model.check_profile(model.Profile((model.Step("SUPPLIES"),), "DEVICE"))


def test_the_filter_on_the_source_reaches_the_scan(spark, tmp_path):
    o, links = graph(spark, *CHAIN)
    links.write.parquet(str(tmp_path / "links"))
    plan = T.paths(spark.read.parquet(str(tmp_path / "links")), o, RISK, "sup-1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(from_id,sup-1)" in plan


def test_contract_is_stable_and_shows_drift():
    text = model.serialized_contract()
    assert text == model.serialized_contract() and model.contract_drift(text) == []
    assert model.contract_drift(text.replace("CLASS_III", "CLASS_IV")) == ["DEVICE"]


def test_registry_rules():
    with pytest.raises(ValueError):
        model.ObjectType("X", (model.Property("a"), model.Property("a")))
    with pytest.raises(ValueError):
        model.ObjectType("X", (model.Property("a", "MAP"),))
    with pytest.raises(ValueError):
        model.ObjectType("X", (model.Property("a", required=False, multiple=True),))


def test_report(spark):
    o, links = graph(spark, *CHAIN)
    names = spark.createDataFrame([("part-1", "Seal"), ("dev-1", "Pump")], "id string, name string")
    report = T.risk_report(T.best_paths(T.paths(links, o, RISK, "sup-1"), RISK), RISK, names)
    assert rows(report) == [("sup-1", "dev-1", "Pump", "0.800", 2, "Seal (0.900) > Pump (0.800)*")]
