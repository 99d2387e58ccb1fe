"""The bottleneck form carries the smaller end of a path, whichever that is."""

import re

from pyspark.sql import functions as F

from provgraph import model
from provgraph.operators import traverse as T
from tests.conftest import rows
from tests.test_traverse import graph

EXPOSURE = model.SUPPLIER_SITE_EXPOSURE


def case(spark, n_suppliers, n_sites):
    objects = {"SUPPLIER": [f"s{i}" for i in range(n_suppliers)], "PART": ["p0", "p1"], "DEVICE": ["d0", "d1", "d2"], "SITE": [f"t{i}" for i in range(n_sites)]}
    links = [("SUPPLIES", f"s{i}", f"p{j}", 0.5 + (i * 3 + j) % 7 * 0.05) for i in range(n_suppliers) for j in range(2) if (i + j) % 3]
    links += [("COMPOSED_OF", f"d{i}", f"p{j}", 0.6 + (i + j) * 0.05) for i in range(3) for j in range(2)]
    links += [("MANUFACTURED_AT", f"d{i % 3}", f"t{i}", 0.5 + i % 5 * 0.09) for i in range(n_sites)]
    links.append(("MANUFACTURED_AT", "d1", "t0", 0.9))
    return graph(spark, objects, links)


def test_both_directions_equal_paths(spark):
    for size in ((9, 2), (2, 9)):
        o, links = case(spark, *size)
        want = T.target_scores(T.paths(links, o, EXPOSURE), EXPOSURE)
        got = T.bottleneck_scores(links, EXPOSURE)
        assert got.count() == want.count() > 0
        assert rows(got.select(*want.columns)) == rows(want)


def test_one_step(spark):
    o, links = case(spark, 4, 2)
    p = model.PART_SUPPLIERS
    want = T.target_scores(T.paths(links, o, p), p)
    assert rows(T.bottleneck_scores(links, p).select(*want.columns)) == rows(want)


def test_what_is_carried_is_of_the_smaller_end(spark):
    """1,000 suppliers of one part in 100 devices at 2 sites: 100,000 pairs of supplier and device are not carried."""
    supplies = spark.range(1000).select(F.lit("SUPPLIES").alias("link_type"), F.concat(F.lit("s"), "id").alias("from_id"), F.lit("p").alias("to_id"))
    composed = spark.range(100).select(F.lit("COMPOSED_OF").alias("link_type"), F.concat(F.lit("d"), "id").alias("from_id"), F.lit("p").alias("to_id"))
    made = spark.range(100).select(F.lit("MANUFACTURED_AT").alias("link_type"), F.concat(F.lit("d"), "id").alias("from_id"), F.concat(F.lit("t"), F.col("id") % 2).alias("to_id"))
    links = supplies.union(composed).union(made).select(F.concat_ws("|", "*").alias("id"), "*", F.lit("0.500").cast("decimal(4,3)").alias("confidence"))
    got = T.bottleneck_scores(links, EXPOSURE)
    assert got.count() == 2000 and got.where("path_count <> 50").count() == 0
    filters = re.findall(r"link_type#\d+ = (\w+)", got._jdf.queryExecution().analyzed().toString())
    assert filters == ["MANUFACTURED_AT", "COMPOSED_OF", "SUPPLIES"]  # from left to right, as they are joined
