"""The graph's schema as data: object types, properties, link types, and checks of them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

CONFIDENCE = T.DecimalType(4, 3)
VALUE_TYPES = {"STRING": T.StringType(), "NUMBER": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.StringType()}
# How a value came about, who acts, and the closed states of records.
METHODS = ("DIRECT", "FUZZY_MATCH", "LLM_EXTRACTION", "HUMAN_ENTRY", "INFERRED")
ACTOR_TYPES = ("HUMAN", "AGENT")
AUDIT_STATUS = ("PROPOSED", "APPROVED", "REJECTED", "EXECUTED")
APPLIED_VIA = ("MIGRATION", "AGENT_PROPOSAL")
PROPOSAL_STATUS = ("PENDING", "CONFIRMED", "REJECTED")
SCHEMA_VERSION = "0.2.0"


@dataclass(frozen=True)
class Property:
    """A declared property. `enum` lists the closed values, `minimum` a lower bound of numbers."""

    name: str
    value_type: str = "STRING"
    required: bool = True
    multiple: bool = False
    enum: tuple[str, ...] = ()
    minimum: float | None = None
    mutability: str = "EDITABLE"


@dataclass(frozen=True)
class ObjectType:
    name: str
    properties: tuple[Property, ...]

    def __post_init__(self) -> None:
        names = [p.name for p in self.properties]
        if len(set(names)) != len(names) or "id" in names:
            raise ValueError(f"{self.name}: property names must be unique and not 'id'")
        for p in self.properties:
            if p.value_type not in VALUE_TYPES:
                raise ValueError(f"{self.name}.{p.name}: unsupported value type {p.value_type}")
            if p.multiple and not p.required:
                raise ValueError(f"{self.name}.{p.name}: a list is empty, never absent")
            if p.enum and p.value_type != "STRING":
                raise ValueError(f"{self.name}.{p.name}: only strings have closed values")

    def property(self, name: str) -> Property:
        return next(p for p in self.properties if p.name == name)


@dataclass(frozen=True)
class LinkType:
    name: str
    source: str
    target: str
    cardinality: str = "MANY_TO_MANY"


def _enum(name: str, *values: str, **more) -> Property:
    return Property(name, enum=values, **more)


# The declared object types with their closed lists, and the link types.
OBJECT_TYPES = {
    t.name: t
    for t in (
        ObjectType("SUPPLIER", (
            Property("legalName"), Property("duns", required=False), Property("country"),
            _enum("tier", "TIER_1", "TIER_2", "TIER_3"),
            _enum("status", "APPROVED", "PROVISIONAL", "SUSPENDED", "DISQUALIFIED", mutability="ACTION_ONLY"),
            Property("qualityRating", "NUMBER"), Property("certifications", multiple=True),
            Property("aliases", multiple=True), Property("mergedFrom", multiple=True),
        )),
        ObjectType("PART", (
            Property("partNumber"), Property("description"),
            _enum("classification", "DIRECT_MATERIAL", "COMPONENT", "SUBASSEMBLY"),
            _enum("criticality", "CRITICAL", "MAJOR", "MINOR"),
            Property("requiresRequalification", "BOOLEAN", mutability="ACTION_ONLY"),
            Property("unitCost", "NUMBER", minimum=0.0),
        )),
        ObjectType("DEVICE", (
            Property("deviceName"), Property("productFamily"),
            _enum("regulatoryClass", "CLASS_I", "CLASS_II", "CLASS_III"),
            _enum("lifecycleStage", "DEVELOPMENT", "ACTIVE", "END_OF_LIFE", "DISCONTINUED"),
        )),
        ObjectType("SITE", (
            Property("siteName"), Property("country"),
            _enum("siteType", "MANUFACTURING", "ASSEMBLY", "STERILIZATION", "DISTRIBUTION"),
        )),
        ObjectType("QUALITY_EVENT", (
            _enum("eventType", "AUDIT_FINDING", "NONCONFORMANCE", "COMPLAINT", "RECALL"),
            _enum("severity", "CRITICAL", "MAJOR", "MINOR"), Property("openedAt", "TIMESTAMP"),
            Property("closedAt", "TIMESTAMP", required=False), Property("description"),
        )),
    )
}
LINK_TYPES = {
    t.name: t
    for t in (
        LinkType("SUPPLIES", "SUPPLIER", "PART"),
        LinkType("COMPOSED_OF", "DEVICE", "PART"),
        LinkType("MANUFACTURED_AT", "DEVICE", "SITE"),
        LinkType("AFFECTS_SUPPLIER", "QUALITY_EVENT", "SUPPLIER", "MANY_TO_ONE"),
        LinkType("AFFECTS_PART", "QUALITY_EVENT", "PART"),
    )
}

PROVENANCE = T.StructType(
    [
        T.StructField("method", T.StringType()),
        T.StructField("source_system", T.StringType()),
        T.StructField("source_record_id", T.StringType()),
        T.StructField("pipeline_run_id", T.StringType()),
        T.StructField("extracted_at", T.TimestampType()),
    ]
)
VERIFICATION = T.StructType([T.StructField("by", T.StringType()), T.StructField("at", T.TimestampType())])


def tracked_type(value_type: str) -> T.StructType:
    """A value with its confidence, origin and optional verification."""
    return T.StructType(
        [
            T.StructField("value", VALUE_TYPES[value_type]),
            T.StructField("confidence", CONFIDENCE),
            T.StructField("provenance", PROVENANCE),
            T.StructField("verification", VERIFICATION),
        ]
    )


def wide_schema(object_type: str) -> T.StructType:
    """The schema of the wide frame of an object type: id and one tracked column per property."""
    columns = [T.StructField("id", T.StringType(), False)]
    for p in OBJECT_TYPES[object_type].properties:
        one = tracked_type(p.value_type)
        columns.append(T.StructField(p.name, T.ArrayType(one) if p.multiple else one))
    return T.StructType(columns)


def contract() -> dict:
    """The schema as a JSON-Schema-like document, keys sorted, for drift checks."""
    scalar = {"STRING": {"type": "string"}, "NUMBER": {"type": "number"}, "BOOLEAN": {"type": "boolean"},
              "TIMESTAMP": {"type": "string", "format": "date-time"}}

    def value(p: Property) -> dict:
        one = dict(scalar[p.value_type])
        if p.enum:
            one["enum"] = list(p.enum)
        elif p.value_type == "STRING":
            one["minLength"] = 1
        if p.minimum is not None:
            one["minimum"] = p.minimum
        return {"type": "array", "items": one} if p.multiple else one

    types = {
        t.name: {
            "type": "object",
            "additionalProperties": False,
            "required": ["id", *(p.name for p in t.properties if p.required)],
            "properties": {"id": {"type": "string", "minLength": 1}} | {p.name: value(p) for p in t.properties},
        }
        for t in OBJECT_TYPES.values()
    }
    links = {t.name: {"from": t.source, "to": t.target, "cardinality": t.cardinality} for t in LINK_TYPES.values()}
    return {"version": SCHEMA_VERSION, "objectTypes": types, "linkTypes": links}


def pascal_case(name: str) -> str:
    """QUALITY_EVENT becomes QualityEvent: the names of classes made from the contract."""
    return "".join(part[:1] + part[1:].lower() for part in name.split("_"))


def class_definitions() -> dict[str, dict]:
    """The object types of the contract under the names of their classes."""
    return {pascal_case(name): body for name, body in contract()["objectTypes"].items()}


def serialized_contract() -> str:
    return json.dumps(contract(), sort_keys=True, indent=2)


def contract_drift(stored: str) -> list[str]:
    """Names of object and link types whose stored form differs from the registry (sorted)."""
    old, new = json.loads(stored), json.loads(serialized_contract())
    out = [] if old.get("version") == new["version"] else ["version"]
    for part in ("objectTypes", "linkTypes"):
        a, b = old.get(part, {}), new[part]
        out += [n for n in sorted({*a, *b}) if a.get(n) != b.get(n)]
    return out


@dataclass(frozen=True)
class Step:
    """One hop: a link type followed from source to target (ALONG) or back (AGAINST)."""

    link_type: str
    direction: str = "ALONG"


@dataclass(frozen=True)
class Profile:
    """A fixed path pattern and the object type it ends at."""

    steps: tuple[Step, ...]
    to: str
    name: str = field(default="", compare=False)

    def source(self) -> str:
        first = LINK_TYPES[self.steps[0].link_type]
        return first.source if self.steps[0].direction == "ALONG" else first.target


def type_after(object_type: str, step: Step) -> str:
    """The type reached from `object_type` by `step`; ValueError if the step doesn't start there."""
    if step.link_type not in LINK_TYPES or step.direction not in ("ALONG", "AGAINST"):
        raise ValueError(f"unknown step {step}")
    link = LINK_TYPES[step.link_type]
    start, end = (link.source, link.target) if step.direction == "ALONG" else (link.target, link.source)
    if start != object_type:
        raise ValueError(f"{step.link_type} {step.direction} starts at {start}, not at {object_type}")
    return end


def check_profile(profile: Profile, source_type: str | None = None) -> str:
    """The terminal type of a profile; ValueError if it is empty, doesn't chain or ends elsewhere."""
    if not profile.steps:
        raise ValueError("a profile needs at least one step")
    at = source_type or profile.source()
    for step in profile.steps:
        at = type_after(at, step)
    if at != profile.to:
        raise ValueError(f"the pattern ends at {at}, not at {profile.to}")
    return at


SUPPLIER_DEVICE_RISK = Profile((Step("SUPPLIES"), Step("COMPOSED_OF", "AGAINST")), "DEVICE", "SUPPLIER_DEVICE_RISK")
SUPPLIER_SITE_EXPOSURE = Profile(
    (Step("SUPPLIES"), Step("COMPOSED_OF", "AGAINST"), Step("MANUFACTURED_AT")), "SITE", "SUPPLIER_SITE_EXPOSURE"
)
PART_SUPPLIERS = Profile((Step("SUPPLIES", "AGAINST"),), "SUPPLIER", "PART_SUPPLIERS")
CO_SUPPLIERS = Profile((Step("SUPPLIES"), Step("SUPPLIES", "AGAINST")), "SUPPLIER", "CO_SUPPLIERS")
EVENT_DEVICE_IMPACT = Profile((Step("AFFECTS_PART"), Step("COMPOSED_OF", "AGAINST")), "DEVICE", "EVENT_DEVICE_IMPACT")
PROFILES = {p.name: p for p in (SUPPLIER_DEVICE_RISK, SUPPLIER_SITE_EXPOSURE, PART_SUPPLIERS, CO_SUPPLIERS, EVENT_DEVICE_IMPACT)}
