"""Master data to graph: first-failure validation, deterministic ids, orphan links, tallies, tracked objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.functions.skew import hot_keys, salted_join
from provgraph.functions.text import squeeze
from provgraph.model import CONFIDENCE, OBJECT_TYPES, PROVENANCE, VALUE_TYPES, VERIFICATION
from provgraph.operators.tracked import explode_objects

# The closed lists of reject and skip codes, in report order.
REJECT_CODES = [
    "VENDOR_MISSING_LIFNR", "VENDOR_MISSING_NAME", "VENDOR_INVALID_TIER", "VENDOR_INVALID_QUALITY_RATING", "VENDOR_DUPLICATE_LIFNR",
    "MATERIAL_MISSING_MATNR", "MATERIAL_INVALID_UNIT_COST", "MATERIAL_INVALID_CLASSIFICATION", "MATERIAL_INVALID_CRITICALITY",
    "DEVICE_MISSING_ID", "DEVICE_MISSING_NAME", "DEVICE_INVALID_REG_CLASS", "DEVICE_INVALID_LIFECYCLE",
]
SKIP_CODES = ["SUPPLY_ORPHAN_VENDOR", "SUPPLY_ORPHAN_MATERIAL", "BOM_ORPHAN_DEVICE", "BOM_ORPHAN_PART"]
# The number grammar of the sources.
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
# Legal forms at the end of a name. Those of the first list may also be written with
# dots or blanks between their letters (g.m.b.h., s. a.), those of the second with a dot at the end.
SPELLED_FORMS = ["gmbh", "sa"]
DOTTED_FORMS = ["ltd", "inc", "corp", "co"]
PLAIN_FORMS = ["limited", "kg", "ag"]
#: Namespace of the identifiers; that of an existing installation keeps its identifiers the same.
ID_NAMESPACE = "provgraph/ingest/v1"


def _bound(c: Column, f) -> Column:
    """f(c) with c computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _radix(t: Column) -> Column:
    """The value of marked digits (0x, 0o, 0b) as the nearest double: the leading 60 bits as they are,
    the rest as a power of two; what is cut off only decides how the last bit is rounded."""
    mark, digits = F.lower(F.substring(t, 2, 1)), F.regexp_replace(t, r"\A0[xXoObB]0*", "")
    bits = F.when(mark == "x", 4).when(mark == "o", 3).otherwise(1)
    base = F.when(mark == "x", 16).when(mark == "o", 8).otherwise(2)
    kept = (F.lit(60) / bits).cast("int")
    rest = F.substr(digits, kept + 1)
    head = F.coalesce(F.call_function("conv", F.substr(digits, F.lit(1), kept), base, F.lit(10)).try_cast("long"), F.lit(0))
    head = F.when(rest.rlike("[^0]"), head.bitwiseOR(F.lit(1))).otherwise(head)
    return head.cast("double") * F.pow(F.lit(2.0), F.length(rest) * bits)


def number(c: Column) -> Column:
    """The finite number a source cell holds, 0 for a blank one; null if it holds none. Hexadecimal
    (0x), octal (0o) and binary (0b) digits without a sign are numbers of any length."""

    def value(t: Column) -> Column:
        marked = t.rlike(r"\A0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)\z")
        found = F.when(t.rlike(rf"\A{_NUMBER}\z"), t.try_cast("double")).when(t == "", F.lit(0.0)).when(marked, _radix(t))
        return F.when(F.abs(found) < F.lit(float("inf")), found)

    return _bound(squeeze(c), value)


def _without_form(words: Column) -> Column:
    """The words of a name without the legal form at their end; a name is never a legal form only."""

    def is_form(n: int) -> Column:
        tail = F.array_join(F.slice(words, -n, n), "")
        letters = F.replace(tail, F.lit("."), F.lit(""))
        spelled = letters.isin(SPELLED_FORMS) & ~tail.startswith(".") & ~tail.contains("..")
        one_word = tail.isin([*PLAIN_FORMS, *DOTTED_FORMS, *(f"{f}." for f in DOTTED_FORMS)])
        return (F.size(words) > n) & (spelled | one_word if n == 1 else spelled)

    # A form of four letters takes up four words at most.
    return reduce(lambda e, n: F.when(is_form(n), F.slice(words, 1, F.size(words) - n)).otherwise(e), range(4, 0, -1), words)


def legal_name(c: Column) -> Column:
    """A name for comparing: squeezed, lower case, up to three legal forms at the end and all dots gone."""
    words = F.split(F.lower(squeeze(c)), " ")
    # The fold binds the words, so that each step is computed once.
    kept = F.aggregate(F.sequence(F.lit(1), F.lit(3)), words, lambda w, _: _without_form(w))
    return F.regexp_replace(F.replace(F.array_join(kept, " "), F.lit("."), F.lit("")), r"\s+", " ")


def country(c: Column) -> Column:
    return F.upper(squeeze(c))


def confidence(c: Column, fallback: float) -> Column:
    """A confidence in [0, 1]; anything else, blank included, becomes the fallback."""
    x = _bound(F.when(squeeze(c) != "", number(c)), lambda n: F.when(n.between(0, 1), n))
    return F.coalesce(x, F.lit(fallback)).cast("decimal(4,3)")


def certifications(c: Column) -> Column:
    """Values between bars, squeezed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"\|"), squeeze), lambda x: x != "")


def object_id(system: str, key: Column, namespace: str = ID_NAMESPACE) -> Column:
    """A deterministic identifier in UUID form: SHA-256 of namespace, system and key with zero bytes
    between, with the version and variant bits of a random UUID."""
    h = F.sha2(F.concat(F.lit(f"{namespace}\0{system}\0"), key), 256)
    variant = F.element_at(F.array(*(F.lit(x) for x in "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant,
                    F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _closed(kind: str, name: str) -> list[str]:
    return list(OBJECT_TYPES[kind].property(name).enum)


def _not_in(c: str, kind: str, name: str) -> Column:
    return ~F.upper(squeeze(F.col(c))).isin(_closed(kind, name))


def _blank(c: str) -> Column:
    return squeeze(F.col(c)) == ""


def _first_failure(df: DataFrame, checks: list[tuple[Column, str, Column]]) -> DataFrame:
    """`df` with `code` and `message` of the first check that fails, or nulls."""
    df = df.withColumn("code", F.coalesce(*(F.when(bad, F.lit(code)) for bad, code, _ in checks)))
    # Made from the code alone, so that no check is evaluated twice.
    message = reduce(lambda e, c: F.when(F.col("code") == c[1], c[2]).otherwise(e), checks, F.lit(None).cast("string"))
    return df.withColumn("message", message)


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _cells(rows: DataFrame) -> DataFrame:
    return rows.na.fill("", [c for c in rows.columns if c != "line"])


def checked_vendors(rows: DataFrame) -> DataFrame:
    """`rows` with `code` and `message` of the first check that fails, or nulls. A number that an
    earlier accepted line holds is a duplicate; lines that fail another check don't count for that.

    The first line of each number is a minimum that is combined before the shuffle; it is joined back
    to the accepted rows only, hot numbers salted.
    """
    nr, rating = F.col("_k"), number(F.col("QUALITY_RATING"))
    checked = _first_failure(_cells(rows).withColumn("_k", squeeze(F.col("LIFNR"))), [
        (nr == "", "VENDOR_MISSING_LIFNR", F.lit("LIFNR is blank")),
        (_blank("NAME1"), "VENDOR_MISSING_NAME", _text("vendor ", nr, " has blank NAME1")),
        (_not_in("TIER", "SUPPLIER", "tier"), "VENDOR_INVALID_TIER", _text("vendor ", nr, " has invalid TIER ", F.col("TIER"))),
        (_blank("QUALITY_RATING") | rating.isNull(), "VENDOR_INVALID_QUALITY_RATING", _text("vendor ", nr, " has non-numeric QUALITY_RATING")),
    ]).withColumn("_k", F.when(F.col("code").isNull(), nr))
    firsts = checked.where("_k is not null").groupBy("_k").agg(F.min("line").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # Only numbers with several accepted lines can be duplicates.
    joined = salted_join(checked, firsts.where("_n > 1").drop("_n"), ["_k"], "line", hot_keys(firsts, ["_k"], "_n"), "left")
    repeated = F.col("line") > F.col("_first")
    return joined.withColumns(
        {
            "code": F.when(repeated, "VENDOR_DUPLICATE_LIFNR").otherwise(F.col("code")),
            "message": F.when(repeated, _text("duplicate LIFNR ", F.col("_k"), " (first at line ", F.col("_first").cast("string"), ")")).otherwise(F.col("message")),
        }
    ).drop("_k", "_first")


def checked_materials(rows: DataFrame) -> DataFrame:
    cost, nr = F.col("_cost"), F.col("_k")
    rows = _cells(rows).withColumns({"_cost": number(F.col("UNIT_COST")), "_k": squeeze(F.col("MATNR"))})
    return _first_failure(rows, [
        (nr == "", "MATERIAL_MISSING_MATNR", F.lit("MATNR is blank")),
        (_blank("UNIT_COST") | cost.isNull() | (cost < 0), "MATERIAL_INVALID_UNIT_COST", _text("material ", nr, " has invalid UNIT_COST")),
        (_not_in("CLASS", "PART", "classification"), "MATERIAL_INVALID_CLASSIFICATION", _text("material ", nr, " has invalid CLASS")),
        (_not_in("CRITICALITY", "PART", "criticality"), "MATERIAL_INVALID_CRITICALITY", _text("material ", nr, " has invalid CRITICALITY")),
    ]).drop("_cost", "_k")


def checked_devices(rows: DataFrame) -> DataFrame:
    nr = F.col("_k")
    return _first_failure(_cells(rows).withColumn("_k", squeeze(F.col("DEVICE_ID"))), [
        (nr == "", "DEVICE_MISSING_ID", F.lit("DEVICE_ID is blank")),
        (_blank("DEVICE_NAME"), "DEVICE_MISSING_NAME", _text("device ", nr, " has blank DEVICE_NAME")),
        (_not_in("REG_CLASS", "DEVICE", "regulatoryClass"), "DEVICE_INVALID_REG_CLASS", _text("device ", nr, " has invalid REG_CLASS")),
        (_not_in("LIFECYCLE", "DEVICE", "lifecycleStage"), "DEVICE_INVALID_LIFECYCLE", _text("device ", nr, " has invalid LIFECYCLE")),
    ]).drop("_k")


def linked(rows: DataFrame, sides: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """`rows` with `code` and `message`: for the first of `sides` (column, accepted rows, their key,
    code) whose key no accepted row holds; nulls where all are there. Hot keys are salted."""
    out = _cells(rows)
    for k, (column, accepted, key, _) in enumerate(sides):
        known = accepted.select(squeeze(F.col(key)).alias(f"_k{k}")).distinct().withColumn(f"_there{k}", F.lit(True))
        keys = _cells(rows).select(squeeze(F.col(column)).alias(f"_k{k}"))
        out = salted_join(out.withColumn(f"_k{k}", squeeze(F.col(column))), known, [f"_k{k}"], "line", hot_keys(keys, [f"_k{k}"]), "left")
    absent = [(F.col(f"_there{k}").isNull(), s[3], _text(f"unknown {s[0]} ", F.col(f"_k{k}"))) for k, s in enumerate(sides)]
    return _first_failure(out, absent).drop(*[f"{p}{k}" for k in range(len(sides)) for p in ("_k", "_there")])


def _value(value_type: str, c: Column) -> Column:
    return c.cast(VALUE_TYPES[value_type])


# For each file its object type, system, key column, and where a new object's properties come from.
OBJECT_SOURCES = {
    "vendor_master": ("SUPPLIER", "SAP_VENDOR_MASTER", "LIFNR"),
    "material_master": ("PART", "SAP_MATERIAL_MASTER", "MATNR"),
    "device_master": ("DEVICE", "SAP_DEVICE_MASTER", "DEVICE_ID"),
}
#: File, link type, start (file, column), confidence where the row has none, source system.
LINK_SOURCES = [
    ("supply_relationship", "SUPPLIES", ("vendor_master", "LIFNR"), 0.9, "SAP_SUPPLY_REL"),
    ("device_bom", "COMPOSED_OF", ("device_master", "DEVICE_ID"), 0.85, "SAP_DEVICE_BOM"),
]


def _property_values(kind: str) -> dict[str, Column]:
    """What a new object of this type holds: one column per property, null where there is no value."""
    text, upper, blank_as_null = (lambda c: squeeze(F.col(c))), (lambda c: F.upper(squeeze(F.col(c)))), (lambda x: F.when(x != "", x))
    if kind == "SUPPLIER":
        none = F.array().cast("array<string>")
        return {
            "legalName": text("NAME1"), "duns": blank_as_null(text("DUNS")), "country": text("LAND1"), "tier": upper("TIER"),
            "status": F.lit("PROVISIONAL"), "qualityRating": number(F.col("QUALITY_RATING")),
            "certifications": certifications(F.col("CERTIFICATIONS")), "aliases": none, "mergedFrom": none,
        }
    if kind == "PART":
        return {
            "partNumber": text("MATNR"), "description": text("MAKTX"), "classification": upper("CLASS"), "criticality": upper("CRITICALITY"),
            "requiresRequalification": F.lit(False), "unitCost": number(F.col("UNIT_COST")),
        }
    return {"deviceName": text("DEVICE_NAME"), "productFamily": text("PRODUCT_FAMILY"), "regulatoryClass": upper("REG_CLASS"), "lifecycleStage": upper("LIFECYCLE")}


class Plan:
    """What a bundle becomes: accepted rows, rejects, links and skipped links. Making a plan only looks
    for hot keys; the frames are lazy. The texts of messages are fixed values."""

    def __init__(self, bundle: dict[str, DataFrame], namespace: str = ID_NAMESPACE):
        self.namespace = namespace
        self.vendors = checked_vendors(bundle["vendor_master"])
        self.materials = checked_materials(bundle["material_master"])
        self.devices = checked_devices(bundle["device_master"])
        ok = lambda df: df.where("code is null")
        self.supply = linked(bundle["supply_relationship"], [
            ("LIFNR", ok(self.vendors), "LIFNR", "SUPPLY_ORPHAN_VENDOR"), ("MATNR", ok(self.materials), "MATNR", "SUPPLY_ORPHAN_MATERIAL"),
        ])
        self.bom = linked(bundle["device_bom"], [
            ("DEVICE_ID", ok(self.devices), "DEVICE_ID", "BOM_ORPHAN_DEVICE"), ("MATNR", ok(self.materials), "MATNR", "BOM_ORPHAN_PART"),
        ])
        self.files = {
            "vendor_master": self.vendors, "material_master": self.materials, "device_master": self.devices,
            "supply_relationship": self.supply, "device_bom": self.bom,
        }

    def _accepted(self, file: str) -> DataFrame:
        return self.files[file].where("code is null")

    def _coded(self, files: list[str]) -> DataFrame:
        parts = [self.files[f].where("code is not null").select("code", F.lit(f"{f}.csv").alias("file"), "line", "message") for f in files]
        return reduce(DataFrame.unionByName, parts)

    def rejects(self) -> DataFrame:
        """(code, file, line, message) of every rejected row."""
        return self._coded(list(OBJECT_SOURCES))

    def skipped(self) -> DataFrame:
        """(code, file, line, message) of every link row without one of its ends."""
        return self._coded([s[0] for s in LINK_SOURCES])

    def tallies(self) -> DataFrame:
        """(code, n) over the closed lists of codes, zeros included."""
        return zero_filled(self.rejects().unionByName(self.skipped()), "code", REJECT_CODES + SKIP_CODES)

    def accepted_counts(self) -> DataFrame:
        """(entity, n): accepted rows of each kind of object and links of each type, zeros included."""
        kinds = {"vendor_master": "vendors", "material_master": "materials", "device_master": "devices", "supply_relationship": "supplyLinks", "device_bom": "bomLinks"}
        parts = [self._accepted(f).select(F.lit(name).alias("entity")) for f, name in kinds.items()]
        return zero_filled(reduce(DataFrame.unionByName, parts), "entity", list(kinds.values()))

    def _key(self, file: str) -> Column:
        return squeeze(F.col(OBJECT_SOURCES[file][2]))

    def _id(self, file: str, k: Column) -> Column:
        return object_id(OBJECT_SOURCES[file][1], k, self.namespace)

    def objects(self) -> DataFrame:
        """(id, object_type, source_system, source_key, source_record_id) of the accepted rows."""
        parts = []
        for file, (kind, system, _) in OBJECT_SOURCES.items():
            parts.append(self._accepted(file).select(
                self._id(file, self._key(file)).alias("id"), F.lit(kind).alias("object_type"), F.lit(system).alias("source_system"),
                self._key(file).alias("source_key"), _row_reference(file),
            ))
        return reduce(DataFrame.unionByName, parts)

    def tracked_objects(self, object_type: str, run_id: str, extracted_at) -> DataFrame:
        """The wide frame (see `model.wide_schema`) of the accepted rows of a type: every property
        certain, read directly from its row; new suppliers are provisional, a blank DUNS is absent."""
        file, system = next((f, s) for f, (kind, s, _) in OBJECT_SOURCES.items() if kind == object_type)
        values = _property_values(object_type)
        origin = F.struct(
            F.lit("DIRECT").alias("method"), F.lit(system).alias("source_system"), _row_reference(file),
            F.lit(run_id).alias("pipeline_run_id"), F.lit(extracted_at).cast("timestamp").alias("extracted_at"),
        )

        def tracked(value_type: str, v: Column) -> Column:
            return F.struct(
                _value(value_type, v).alias("value"), F.lit(1).cast(CONFIDENCE).alias("confidence"), origin.alias("provenance"),
                F.lit(None).cast(VERIFICATION).alias("verification"),
            )

        columns = []
        for p in OBJECT_TYPES[object_type].properties:
            v = values[p.name]
            one = F.transform(v, lambda x: tracked(p.value_type, x)) if p.multiple else F.when(v.isNotNull(), tracked(p.value_type, v))  # noqa: B023
            columns.append(one.alias(p.name))
        return self._accepted(file).select(self._id(file, self._key(file)).alias("id"), *columns)

    def property_rows(self, run_id: str, extracted_at) -> DataFrame:
        """The property rows of all accepted rows (see `tracked.explode_objects`)."""
        kinds = [kind for kind, _, _ in OBJECT_SOURCES.values()]
        return reduce(DataFrame.unionByName, [explode_objects(self.tracked_objects(k, run_id, extracted_at), k) for k in kinds])

    def links(self) -> DataFrame:
        """(link_type, from_id, to_id, confidence, source_system, source_record_id) of the rows with both ends."""
        parts = []
        for file, kind, (start, column), fallback, system in LINK_SOURCES:
            parts.append(self._accepted(file).select(
                F.lit(kind).alias("link_type"), self._id(start, squeeze(F.col(column))).alias("from_id"),
                self._id("material_master", squeeze(F.col("MATNR"))).alias("to_id"), confidence(F.col("CONFIDENCE"), fallback).alias("confidence"),
                F.lit(system).alias("source_system"), _row_reference(file),
            ))
        return reduce(DataFrame.unionByName, parts)


def _row_reference(file: str) -> Column:
    return F.concat(F.lit(f"{file}.csv:"), F.col("line").cast("string")).alias("source_record_id")


def zero_filled(df: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """(column, n): counts over a closed list, 0 where there is no row."""
    all_codes = df.sparkSession.createDataFrame([(c,) for c in codes], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return all_codes.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def tally_differences(tallies: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(code, n, expected) where a tally differs from a manifest; codes it doesn't name count 0."""
    want = tallies.sparkSession.createDataFrame(list(expected.items()) or [("", 0)], "code string, expected long").where("code <> ''")
    both = tallies.join(want, "code", "full").select("code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.where("n <> expected")
