import random

from pyspark.sql import functions as F

from provgraph.functions.text import key
from provgraph.operators import references as R
from tests.conftest import day, rows

PARENT = "id string, seen timestamp, gone timestamp, target string"
CHILD = "no int, ref string, at timestamp, key string"


def run(spark, parents, children):
    p = spark.createDataFrame([(*r, "clash") for r in parents], PARENT)
    c = spark.createDataFrame([(*r, "clash") for r in children], CHILD)
    return rows(
        R.failing_references(
            [R.parent_keys("t", p, key(F.col("id")), F.col("seen"), F.col("gone"))],
            [R.child_keys("src", "ref", "t", c, key(F.col("ref")), F.col("no"), F.col("at"))],
        )
    )


def brute(parents, children):
    norm = lambda s: " ".join(s.split()).lower() or None if s is not None else None
    out = []
    for no, ref, at in children:
        k = norm(ref)
        if k is None:
            continue
        mine = [(s, g) for i, s, g in parents if norm(i) == k]
        seen = [s for s, _ in mine if s]
        gone = [g for _, g in mine]
        if not mine:
            status = "missing"
        elif at and seen and min(seen) > at:
            status = "late"
        elif at and all(gone) and max(gone) <= at:
            status = "deleted"
        else:
            continue
        out.append(("src", "ref", str(no), status, at.strftime("%Y-%m") if at else None))
    return sorted(out, key=repr)


def test_each_status(spark):
    parents = [(" A ", day(5), None), ("a", day(2), None), ("b", day(1), day(9)), ("b", day(3), day(20)), ("c", day(1), day(4)), ("c", day(2), None)]
    children = [(1, "a", day(1)), (2, "A", day(2)), (3, "B", day(20)), (4, "b", day(19)), (5, "x", day(40)), (6, "c", day(9)),
                (7, None, day(1)), (8, " ", day(1)), (9, "y", None), (10, "a", None), (5, "x", day(40))]
    assert run(spark, parents, children) == brute(parents, children)
    assert [r[3] for r in run(spark, parents, children)].count("missing") == 3


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [("a", day(0), None)], []) == []
    assert [r[3] for r in run(spark, [], [(1, "a", day(0))])] == ["missing"]


def test_random_with_hot_keys(spark, salting):
    rnd = random.Random(3)
    some = lambda: rnd.choice([None, day(rnd.randrange(60))])
    parents = [(rnd.choice("abcdef"), day(rnd.randrange(60)), some()) for _ in range(12)]
    children = [(i, rnd.choice("aaaaaabcdefgh "), some() or day(3)) for i in range(200)]
    assert run(spark, parents, children) == brute(parents, children)


def test_counts_per_period(spark):
    c = spark.createDataFrame([(1, "x", day(0)), (2, "x", day(1)), (3, "x", day(40))], "no int, ref string, at timestamp")
    p = spark.createDataFrame([], "id string, seen timestamp")
    failing = R.failing_references(
        [R.parent_keys("t", p, F.col("id"), F.col("seen"))], [R.child_keys("s", "f", "t", c, F.col("ref"), F.col("no"), F.col("at"))]
    )
    assert rows(R.failures_by_period(failing)) == [("s", "f", "missing", "2025-01", 2), ("s", "f", "missing", "2025-02", 1)]
