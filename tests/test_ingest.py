import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from provgraph.operators import ingest as I
from provgraph.sources import csv_bundle as B
from tests.conftest import day, rows

FILES = {
    "vendor_master": ["100, Acme GmbH ,DE,tier_1,,80,ISO 9001|| ISO 13485", ",X,DE,TIER_1,,1,", "101,  \t ,DE,TIER_1,,1,", "102,X,DE,TIER_9,,1,", "103,X,DE,TIER_1,,good,", "103,X,DE,TIER_1,,0x10,", "103,Y,DE,TIER_1,,1,", '104,"A ""B"", C",DE,TIER_2,,1e1,'],
    "material_master": ["M-1,part,component,minor,1.5", ",p,COMPONENT,MINOR,1", "M-2,p,COMPONENT,MINOR,-1", "M-3,p,PART,MINOR,1", "M-4,p,COMPONENT,LOW,1", "", "M-5,p,SUBASSEMBLY,MAJOR,Infinity"],
    "device_master": ["D-1,dev,fam,class_i,active", ",d,f,CLASS_I,ACTIVE", "D-2,,f,CLASS_I,ACTIVE", "D-3,d,f,CLASS_9,ACTIVE", "D-4,d,f,CLASS_I,OLD"],
    "supply_relationship": ["100,M-1,0.5", "999,M-9,0.5", "103,M-9,", " 103 ,M-1,7"],
    "device_bom": ["D-1,M-1,", "D-9,M-1,1", "D-1,M-3,1"],
}
WANT = {
    "VENDOR_MISSING_LIFNR": 1, "VENDOR_MISSING_NAME": 1, "VENDOR_INVALID_TIER": 1, "VENDOR_INVALID_QUALITY_RATING": 1, "VENDOR_DUPLICATE_LIFNR": 1,
    "MATERIAL_MISSING_MATNR": 1, "MATERIAL_INVALID_UNIT_COST": 2, "MATERIAL_INVALID_CLASSIFICATION": 1, "MATERIAL_INVALID_CRITICALITY": 1,
    "DEVICE_MISSING_ID": 1, "DEVICE_MISSING_NAME": 1, "DEVICE_INVALID_REG_CLASS": 1, "DEVICE_INVALID_LIFECYCLE": 1,
    "SUPPLY_ORPHAN_VENDOR": 1, "SUPPLY_ORPHAN_MATERIAL": 1, "BOM_ORPHAN_DEVICE": 1, "BOM_ORPHAN_PART": 1,
}


@pytest.fixture()
def plan(spark, tmp_path):
    for name, lines in FILES.items():
        (tmp_path / f"{name}.csv").write_text("\r\n".join([",".join(B.FILES[name]), *lines]) + "\r\n", newline="")
    return I.Plan(B.read_bundle(spark, str(tmp_path)))


def test_tallies(spark, plan):
    assert dict(rows(plan.tallies())) == WANT
    assert rows(I.tally_differences(plan.tallies(), WANT)) == []
    assert rows(I.tally_differences(plan.tallies(), WANT | {"VENDOR_MISSING_NAME": 3})) == [("VENDOR_MISSING_NAME", 1, 3)]


def test_line_numbers_skip_blank_lines_and_count_the_header(plan):
    assert rows(plan.rejects().drop("message").where("code = 'VENDOR_DUPLICATE_LIFNR'")) == [("VENDOR_DUPLICATE_LIFNR", "vendor_master.csv", 8)]
    assert ("MATERIAL_INVALID_UNIT_COST", "material_master.csv", 7) in rows(plan.rejects().drop("message"))


def test_accepted_rows_and_links(plan):
    assert sorted(r.source_key for r in plan.objects().collect()) == ["100", "103", "104", "D-1", "M-1"]
    assert rows(plan.links().select("link_type", F.col("confidence").cast("double"), "source_record_id")) == [
        ("COMPOSED_OF", 0.85, "device_bom.csv:2"), ("SUPPLIES", 0.5, "supply_relationship.csv:2"), ("SUPPLIES", 0.9, "supply_relationship.csv:5"),
    ]
    assert rows(plan.vendors.where("LIFNR = '104'").select("NAME1")) == [('A "B", C',)]


def test_functions(spark):
    df = spark.createDataFrame([("  MedSource G.m.b.H. ",), ("MEDSOURCE GMBH",), ("Alpine Polymers Co. Ltd",)], "v string")
    assert [r[0] for r in df.select(I.legal_name(F.col("v"))).collect()] == ["medsource", "medsource", "alpine polymers"]
    one = spark.range(1)
    for key in ("100301", "101001", ""):
        digest = bytearray(hashlib.sha256(f"some/space\0SYS\0{key}".encode()).digest()[:16])
        digest[6], digest[8] = digest[6] & 15 | 64, digest[8] & 63 | 128
        assert one.select(I.object_id("SYS", F.lit(key), "some/space")).head()[0] == str(uuid.UUID(bytes=bytes(digest)))
    assert one.select(I.certifications(F.lit(" a | |b  c"))).head()[0] == ["a", "b c"]
    assert [one.select(I.confidence(F.lit(x), 0.9).cast("double")).head()[0] for x in ("0.25", "", "2", "x", "1e-1")] == [0.25, 0.9, 0.9, 0.9, 0.1]


def test_legal_forms(spark):
    names = {
        "Acme g. m. b. h.": "acme", "Acme S. A.": "acme", "acme s.a": "acme", "Acme Sa Ltd. ": "acme", "Acme Inc. Corp Co. Ltd": "acme inc",
        "GmbH": "gmbh", "Acme k.g.": "acme kg", "Acme l.t.d": "acme ltd", "Acme  Limited": "acme", "Limited.": "limited", "Acme g..mbh": "acme gmbh",
        "": "", "Co": "co", "A Limited.": "a limited", "s a": "s a", "x s a": "x",
    }
    df = spark.createDataFrame([(k,) for k in names], "v string").select("v", I.legal_name(F.col("v")).alias("k"))
    assert {r.v: r.k for r in df.collect()} == names


def test_numbers(spark):
    cells = {
        "0x10": 16.0, "0xFFFFFFFFFFFFFFFFF": float(0xFFFFFFFFFFFFFFFFF), "0x10000000000000000": 2.0**64, "0x20000000000001": float(0x20000000000001),
        "0x20000000000003": float(0x20000000000003), "0x40000000000000000000000000002": float(0x40000000000000000000000000002), "0b101": 5.0, "0o17": 15.0,
        "0x0": 0.0, "-0x10": None, "0b2": None, "0x": None, "": 0.0, " 1e3 ": 1000.0, ".5": 0.5, "1.": 1.0, "NaN": None, "Infinity": None, "1d": None,
        "1e999": None, "0x" + "f" * 300: None, "0b" + "1" * 70: float(int("1" * 70, 2)), "0x80000000000008000000000000001": float(0x80000000000008000000000000001),
    }
    df = spark.createDataFrame([(k,) for k in cells], "v string").select("v", I.number(F.col("v")).alias("n"))
    assert {r.v: r.n for r in df.collect()} == cells


def test_messages_counts_and_tracked_objects(spark, plan):
    assert dict(rows(plan.accepted_counts())) == {"vendors": 3, "materials": 1, "devices": 1, "supplyLinks": 2, "bomLinks": 1}
    said = {r.code: r.message for r in plan.rejects().unionByName(plan.skipped()).collect()}
    assert said["VENDOR_DUPLICATE_LIFNR"] == "duplicate LIFNR 103 (first at line 7)" and said["SUPPLY_ORPHAN_MATERIAL"] == "unknown MATNR M-9"
    assert said["VENDOR_INVALID_TIER"] == "vendor 102 has invalid TIER TIER_9"
    wide = plan.tracked_objects("SUPPLIER", "run-1", day(0)).where("legalName.value = 'Acme GmbH'").head()
    assert wide.duns is None and wide.tier.value == "TIER_1" and wide.status.value == "PROVISIONAL" and wide.qualityRating.value == 80.0
    assert [c.value for c in wide.certifications] == ["ISO 9001", "ISO 13485"] and wide.aliases == []
    assert wide.tier.confidence == 1 and wide.tier.provenance.source_record_id == "vendor_master.csv:2" and wide.tier.verification is None
    back = plan.property_rows("run-1", day(0))
    assert back.groupBy("method", "pipeline_run_id").count().collect()[0][:2] == ("DIRECT", "run-1")
    assert {r.property_name for r in back.where(F.col("object_id") == wide.id).collect()} == {"legalName", "country", "tier", "status", "qualityRating", "certifications"}


def test_hot_keys_change_nothing(spark, tmp_path, salting):
    for name, lines in FILES.items():
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(B.FILES[name]), *lines]))
    again = I.Plan(B.read_bundle(spark, str(tmp_path)))
    assert dict(rows(again.tallies())) == WANT and again.links().count() == 3


def test_headers_and_manifests_are_checked(spark, tmp_path):
    (tmp_path / "device_bom.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError):
        B.read_csv_rows(spark, str(tmp_path / "device_bom.csv"), B.FILES["device_bom"])
    (tmp_path / "manifest.json").write_text('{"version": 1, "typo": 2}')
    with pytest.raises(ValueError):
        B.read_manifest(str(tmp_path))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"'), ("plain", "")], "p string, q string")
    B.write_csv(df.coalesce(1), str(tmp_path / "out"))
    assert rows(B.read_csv_rows(spark, str(tmp_path / "out"), ["p", "q"])) == [(2, "a,b", 'say "x"'), (3, "plain", "")]
