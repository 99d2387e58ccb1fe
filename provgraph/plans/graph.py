"""Queries of the graph operators: over the star-schema graph and over the domain tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph import model
from provgraph.functions.text import key
from provgraph.operators import best_counts, constraints, ingest, traverse, tracked
from provgraph.runtime import load
from provgraph.sources.star_graph import star_graph, star_links, star_objects

SOURCE = "SUP-0"


def _found(spark: SparkSession, d: str, profile: model.Profile, source: str | None = None) -> tuple[DataFrame, traverse.Graph]:
    graph = star_graph(spark, d)
    return traverse.graph_paths(graph, profile, source), graph


def _best(spark: SparkSession, d: str, profile: model.Profile, source: str | None = None) -> DataFrame:
    """Best paths with ids."""
    found, graph = _found(spark, d, profile, source)
    return traverse.named(traverse.best_paths(found, profile, graph), graph, profile)


def _scores(spark: SparkSession, d: str, profile: model.Profile, source: str | None = None) -> tuple[DataFrame, traverse.Graph]:
    found, graph = _found(spark, d, profile, source)
    return traverse.target_scores(found, profile), graph


def c1_supplier_device_risk_one(spark: SparkSession, d: str) -> DataFrame:
    best = traverse.traverse_graph(star_graph(spark, d), model.SUPPLIER_DEVICE_RISK, SOURCE)
    return best.select("target_id", "confidence", "path_count", F.col("n1").alias("via_part"), "c1", "c2", "weakest_step")


def c1_generic_tables_one(spark: SparkSession, d: str) -> DataFrame:
    """The same over the generic tables of links and objects."""
    best = traverse.traverse(star_links(spark, d), star_objects(spark, d), model.SUPPLIER_DEVICE_RISK, SOURCE)
    return best.select("target_id", "confidence", "path_count", F.col("n1").alias("via_part"), "c1", "c2", "weakest_step", "l1", "l2")


def a19_risk_report(spark: SparkSession, d: str) -> DataFrame:
    p = model.SUPPLIER_DEVICE_RISK
    names = load(spark, d, "part").select(F.concat(F.lit("PART-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    return traverse.risk_report(_best(spark, d, p, SOURCE), p, names).drop("source_id")


def _named_source(df: DataFrame, graph: traverse.Graph, profile: model.Profile) -> DataFrame:
    return df.withColumn("source_id", graph.name(profile.source(), F.col("source_id")))


def d1_supplier_device_risk_all(spark: SparkSession, d: str) -> DataFrame:
    p = model.SUPPLIER_DEVICE_RISK
    scores, graph = _scores(spark, d, p)
    return _named_source(scores.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_devices"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
        F.sum("path_count").alias("n_paths"), F.count_if(F.col("path_count") == 1).alias("n_single_route"),
    ), graph, p)


def d1_bottleneck_site_exposure(spark: SparkSession, d: str) -> DataFrame:
    return traverse.bottleneck_of_graph(star_graph(spark, d), model.SUPPLIER_SITE_EXPOSURE)


def c1_supplier_site_exposure_one(spark: SparkSession, d: str) -> DataFrame:
    best = _best(spark, d, model.SUPPLIER_SITE_EXPOSURE, SOURCE)
    return best.select("target_id", "confidence", "path_count", F.col("n1").alias("via_part"), F.col("n2").alias("via_device"), "weakest_step")


def c1_part_suppliers(spark: SparkSession, d: str) -> DataFrame:
    p = model.PART_SUPPLIERS
    scores, graph = _scores(spark, d, p)
    return _named_source(scores.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_suppliers"), F.max("confidence").alias("best_confidence")), graph, p)


def c1_co_suppliers_one(spark: SparkSession, d: str) -> DataFrame:
    p = model.CO_SUPPLIERS
    scores, graph = _scores(spark, d, p, SOURCE)
    return scores.select(graph.name(p.to, F.col("target_id")).alias("target_id"), "confidence", "path_count")


def c1_event_device_impact(spark: SparkSession, d: str) -> DataFrame:
    p = model.EVENT_DEVICE_IMPACT
    scores, graph = _scores(spark, d, p)
    return _named_source(scores.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_devices"), F.max("confidence").alias("max_confidence")), graph, p)


def d3_weakest_step_histogram(spark: SparkSession, d: str) -> DataFrame:
    found = best_counts.best_counts(star_graph(spark, d, by_part=True), model.SUPPLIER_DEVICE_RISK)
    return found.groupBy("weakest_step").agg(
        F.sum("n_pairs").alias("n_pairs"), F.sum(F.col("confidence") * F.col("n_pairs")).cast("decimal(20,3)").alias("sum_confidence")
    )


def d8_shared_prefix(spark: SparkSession, d: str) -> DataFrame:
    p = model.EVENT_DEVICE_IMPACT
    return traverse.shared_prefix(_best(spark, d, p), p)


def _domain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """objects with one row per id (any state of it), property rows, links."""
    raw = load(spark, d, "objects")
    objects = raw.groupBy(key(F.col("id")).alias("id")).agg(F.min("object_type").alias("object_type"), F.max("merged_into_id").alias("merged_into_id"))
    return objects, load(spark, d, "object_properties"), load(spark, d, "links")


def b3_links_per_object(spark: SparkSession, d: str) -> DataFrame:
    links = tracked.adjacency(_domain(spark, d)[2].select("id", "from_id", "to_id", "link_type", "confidence"))
    return links.groupBy("node").agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("direction") == "ALONG").alias("n_along"), F.max("confidence").alias("max_confidence")
    )


def b3_links_of_one(spark: SparkSession, d: str) -> DataFrame:
    links = _domain(spark, d)[2]
    hub = links.groupBy("to_id").count().orderBy(F.desc("count"), "to_id").limit(1).collect()[0][0]
    return tracked.links_of(links, hub).select("id", "link_type", "from_id", "to_id", "confidence")


def _clean_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per (object, property, ordinal), the first by prop_row_id, where names are declared."""
    names = sorted({p.name for t in model.OBJECT_TYPES.values() for p in t.properties})
    rows = load(spark, d, "object_properties").where(F.col("property_name").isin(names) & F.col("value").isNotNull())
    rest = [c for c in tracked.ROW_COLUMNS if c not in ("object_id", "property_name", "ordinal")]
    first = F.min_by(F.struct(*rest), "prop_row_id")
    return rows.groupBy("object_id", "property_name", "ordinal").agg(first.alias("r")).select("object_id", "property_name", "ordinal", "r.*")


def b1_assemble_devices(spark: SparkSession, d: str) -> DataFrame:
    wide = tracked.assemble_objects(_clean_rows(spark, d), _domain(spark, d)[0], "DEVICE")
    names = [p.name for p in model.OBJECT_TYPES["DEVICE"].properties]
    return wide.select("id", *(F.col(n)["value"].alias(n) for n in names), *(F.col(n)["confidence"].alias(f"{n}_confidence") for n in names))


def b1_assemble_suppliers(spark: SparkSession, d: str) -> DataFrame:
    wide = tracked.assemble_objects(_clean_rows(spark, d), _domain(spark, d)[0], "SUPPLIER")
    joined = lambda n: F.array_join(F.transform(n, lambda x: x["value"]), "|")
    return wide.select(
        "id", F.col("legalName")["value"].alias("legal_name"), F.col("qualityRating")["value"].alias("quality_rating"),
        F.size("certifications").cast("long").alias("n_certifications"), joined("certifications").alias("certifications"),
    )


def b1_assemble_all_types(spark: SparkSession, d: str) -> DataFrame:
    """One row per object of every type with all declared properties and their confidences; lists as JSON arrays."""
    rows, objects = _clean_rows(spark, d), _domain(spark, d)[0]
    text = lambda c: c.cast("string")
    parts = []
    for t in model.OBJECT_TYPES.values():
        columns = []
        for p in t.properties:
            c = F.col(p.name)
            pick = lambda f, c=c, p=p: F.to_json(F.transform(c, lambda x: text(x[f])), {"ignoreNullFields": "false"}) if p.multiple else c[f]
            columns += [pick("value").alias(f"{t.name}_{p.name}"), pick("confidence").alias(f"{t.name}_{p.name}_confidence")]
        parts.append(tracked.assemble_objects(rows, objects, t.name).select(F.lit(t.name).alias("object_type"), "id", *columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def b7_explode_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the sites and devices that go through the wide form and come back."""
    rows, objects = _clean_rows(spark, d), _domain(spark, d)[0]
    back = None
    for kind in ("SITE", "DEVICE"):
        part = tracked.explode_objects(tracked.assemble_objects(rows, objects, kind), kind)
        back = part if back is None else back.unionByName(part)
    return back.groupBy("property_name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("confidence").cast("decimal(20,3)").alias("sum_confidence"))


def b7_explode_all_types(spark: SparkSession, d: str) -> DataFrame:
    """Every row of every object type that goes through the wide form and comes back, lists with all ordinals."""
    rows, objects = _clean_rows(spark, d), _domain(spark, d)[0]
    parts = [tracked.explode_objects(tracked.assemble_objects(rows, objects, t), t).withColumn("object_type", F.lit(t)) for t in model.OBJECT_TYPES]
    number = F.col("value_type") == "NUMBER"
    # JSON has no infinity and no NaN: those come back as JSON strings.
    return reduce(DataFrame.unionByName, parts).select(
        "object_type", "object_id", "property_name", "ordinal", "value_type", F.when(~number, F.col("value")).alias("value"),
        F.when(number, F.btrim("value", F.lit('"')).try_cast("double")).alias("number"), "confidence", "source_system", "source_record_id",
        "pipeline_run_id", "extracted_at", "method", "verified_by", "verified_at",
    )


def b14_review_queue(spark: SparkSession, d: str) -> DataFrame:
    _, rows, links = _domain(spark, d)
    return tracked.review_queue(rows, links, 0.5).select("fact", "fact_key", "confidence", "method")


def b16_touched_by_run(spark: SparkSession, d: str) -> DataFrame:
    _, rows, links = _domain(spark, d)
    return tracked.touched_by_run(rows, links, "run-42-031").groupBy("fact", "source_system").agg(F.count(F.lit(1)).alias("n_facts"))


def d12_calibration(spark: SparkSession, d: str) -> DataFrame:
    _, rows, links = _domain(spark, d)
    return tracked.calibration(rows, links).withColumn("mean_confidence", F.round("mean_confidence", 6))


def d7_least_upsert(spark: SparkSession, d: str) -> DataFrame:
    line = load(spark, d, "lineitem")
    runs = [
        line.where(F.col("l_orderkey") % 2 == r).select(
            F.lit("COMPOSED_OF").alias("link_type"), F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"),
            F.round(F.lit(0.4) + F.col("l_discount"), 3).cast("decimal(4,3)").alias("confidence"),
            F.concat(F.lit(f"run-{r}:"), F.col("l_linenumber").cast("string")).alias("source_record_id"),
            (F.col("l_linenumber") + 10 * r).alias("seq"),
        )
        for r in (0, 1)
    ]
    return tracked.least_upsert(runs[0], runs[1])


def d7_least_upsert_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over suppliers and 25 families of parts, split by return flag, so that old and new rows meet in most keys."""
    line = load(spark, d, "lineitem")
    run = F.when(F.col("l_returnflag") == "N", 1).otherwise(0)
    rows = line.select(
        F.lit("SUPPLIES").alias("link_type"), F.col("l_suppkey").alias("from_id"), (F.col("l_partkey") % 25).alias("to_id"),
        F.round(F.lit(0.4) + F.col("l_discount"), 3).cast("decimal(4,3)").alias("confidence"),
        F.concat_ws(":", F.concat(F.lit("run-"), run.cast("string")), "l_orderkey", "l_linenumber").alias("source_record_id"),
        (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber") + run.cast("long") * F.lit(2**50)).alias("seq"), run.alias("run"),
    )
    return tracked.least_upsert(rows.where("run = 0").drop("run"), rows.where("run = 1").drop("run"))


def c6_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    used = load(spark, d, "lineitem").select((F.col("l_partkey") * 3).alias("k"), F.col("l_returnflag").alias("v"))
    return tracked.insert_absent(parts, used, ["k"]).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"))


def c3_resolve_sources(spark: SparkSession, d: str) -> DataFrame:
    objects, rows, _ = _domain(spark, d)
    keys = rows.where(F.col("source_record_id").isNotNull()).select("source_system", F.col("source_record_id").alias("source_key"), "object_id")
    return tracked.resolve_sources(keys, objects).groupBy("source_system").agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_distinct(F.lower(F.trim("object_id"))).alias("n_objects")
    )


def c7_differences(spark: SparkSession, d: str) -> DataFrame:
    supply = load(spark, d, "supply_relationship").select(F.trim("LIFNR").alias("lifnr"))
    vendors = load(spark, d, "vendor_master").select(F.trim("LIFNR").alias("lifnr"))
    return tracked.differences(supply, vendors).groupBy("side", "lifnr").agg(F.count(F.lit(1)).alias("n"))


def _bundle(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: load(spark, d, t).withColumnRenamed("line_no", "line") for t in ("vendor_master", "material_master", "device_master", "supply_relationship", "device_bom")}


def d5_tallies(spark: SparkSession, d: str) -> DataFrame:
    return ingest.Plan(_bundle(spark, d)).tallies()


def b18_rejects(spark: SparkSession, d: str) -> DataFrame:
    return ingest.Plan(_bundle(spark, d)).rejects().drop("message")


def b18_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every rejected row and skipped link with its message."""
    plan = ingest.Plan(_bundle(spark, d))
    return plan.rejects().unionByName(plan.skipped())


def d6_accepted_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.Plan(_bundle(spark, d)).accepted_counts()


def b19_property_rows(spark: SparkSession, d: str) -> DataFrame:
    """The property rows that all accepted rows become; numbers in a column of their own, as texts of numbers differ."""
    rows = ingest.Plan(_bundle(spark, d)).property_rows("run-1", dt.datetime(2026, 1, 15, 9, 30))
    is_number = F.col("value_type") == "NUMBER"
    return rows.select(
        "object_id", "property_name", "ordinal", F.when(~is_number, F.col("value")).alias("value"),
        F.when(is_number, F.col("value").try_cast("double")).alias("num"), "source_record_id",
    )


def c4_skipped_links(spark: SparkSession, d: str) -> DataFrame:
    return ingest.Plan(_bundle(spark, d)).skipped().drop("message")


def b20_links(spark: SparkSession, d: str) -> DataFrame:
    links = ingest.Plan(_bundle(spark, d)).links()
    return links.groupBy("link_type", "confidence").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("to_id").alias("n_parts"))


def h9_object_ids(spark: SparkSession, d: str) -> DataFrame:
    return ingest.Plan(_bundle(spark, d)).objects().select("id", "object_type", "source_key", "source_record_id")


def h2_legal_names(spark: SparkSession, d: str) -> DataFrame:
    names = load(spark, d, "vendor_master").where(F.col("NAME1").isNotNull())
    return names.groupBy(ingest.legal_name(F.col("NAME1")).alias("name_key")).agg(F.count(F.lit(1)).alias("n_rows"))


def h5_confidences(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "device_bom").na.fill("", ["CONFIDENCE"])
    return rows.groupBy(ingest.confidence(F.col("CONFIDENCE"), 0.85).alias("confidence")).agg(F.count(F.lit(1)).alias("n_rows"))


def h6_certifications(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "vendor_master").where(F.col("CERTIFICATIONS").isNotNull())
    return rows.select("line_no", F.posexplode(ingest.certifications(F.col("CERTIFICATIONS"))).alias("pos", "cert"))


def l_property_violations(spark: SparkSession, d: str) -> DataFrame:
    found = constraints.broken_rules(load(spark, d, "object_properties"), F.col("prop_row_id"), constraints.property_rules())
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"))


def l_link_violations(spark: SparkSession, d: str) -> DataFrame:
    return constraints.broken_rules(load(spark, d, "links"), F.col("id"), constraints.link_rules())


def l_object_violations(spark: SparkSession, d: str) -> DataFrame:
    found = constraints.broken_rules(load(spark, d, "objects"), F.col("id"), constraints.object_rules())
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"))


def l6_repeated_edges(spark: SparkSession, d: str) -> DataFrame:
    return constraints.repeated_keys(load(spark, d, "links"), ["link_type", "from_id", "to_id"])


def l7_repeated_property_keys(spark: SparkSession, d: str) -> DataFrame:
    return constraints.repeated_keys(load(spark, d, "object_properties"), constraints.PROPERTY_KEY)


def l10_many_to_one(spark: SparkSession, d: str) -> DataFrame:
    return constraints.repeated_keys(load(spark, d, "links"), ["from_id"], F.col("link_type") == "AFFECTS_SUPPLIER")


def l11_missing_targets(spark: SparkSession, d: str) -> DataFrame:
    return constraints.missing_targets(load(spark, d, "links"), "to_id", load(spark, d, "objects"), "id").select("id", "to_id")


def l11_missing_references(spark: SparkSession, d: str) -> DataFrame:
    """Properties and both ends of links that name an object that isn't there, with the field."""
    links, rows, objects = load(spark, d, "links"), load(spark, d, "object_properties"), load(spark, d, "objects")
    fields = [("links", links, "id", "from_id"), ("links", links, "id", "to_id"), ("object_properties", rows, "prop_row_id", "object_id")]
    parts = [
        constraints.missing_targets(df.select(k, c), c, objects, "id").select(
            F.lit(f"{table}.{c}").alias("field"), F.col(k).cast("string").alias("row_key"), F.col(c).alias("target")
        )
        for table, df, k, c in fields
    ]
    return reduce(DataFrame.unionByName, parts)


def l11_wrong_end_types(spark: SparkSession, d: str) -> DataFrame:
    return constraints.wrong_end_types(load(spark, d, "links"), load(spark, d, "objects"))


def l18_cardinality(spark: SparkSession, d: str) -> DataFrame:
    found = constraints.cardinality_breaks(load(spark, d, "object_properties"), load(spark, d, "objects"))
    return found.groupBy("property_name", "problem").agg(F.count(F.lit(1)).alias("n_objects"))


QUERIES = {
    f.__name__: f
    for f in (
        c1_supplier_device_risk_one, c1_generic_tables_one, a19_risk_report, d1_supplier_device_risk_all, d1_bottleneck_site_exposure, c1_supplier_site_exposure_one,
        c1_part_suppliers, c1_co_suppliers_one, c1_event_device_impact, d3_weakest_step_histogram, d8_shared_prefix,
        b3_links_per_object, b3_links_of_one, b1_assemble_devices, b1_assemble_suppliers, b1_assemble_all_types, b7_explode_round_trip, b7_explode_all_types,
        b14_review_queue, b16_touched_by_run, d12_calibration, d7_least_upsert, d7_least_upsert_overlap, c6_insert_absent, c3_resolve_sources,
        c7_differences, d5_tallies, b18_rejects, b18_messages, d6_accepted_counts, b19_property_rows, c4_skipped_links, b20_links, h9_object_ids, h2_legal_names, h5_confidences,
        h6_certifications, l_property_violations, l_link_violations, l_object_violations, l6_repeated_edges,
        l7_repeated_property_keys, l10_many_to_one, l11_missing_targets, l11_missing_references, l11_wrong_end_types, l18_cardinality,
    )
}
