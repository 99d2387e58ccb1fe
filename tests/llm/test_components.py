import random

from provgraph.llm.components import components
from tests.conftest import rows


def brute(edges):
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


def run(spark, edges):
    return rows(components(spark.createDataFrame([(*e, "clash") for e in edges], "a string, b string, p string")))


def test_empty_and_edges_that_tie_nothing(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", "a"), (None, "b"), ("c", None)]) == []


def test_long_chain_star_and_repeats(spark, salting):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    star = [(f"s{i:03}", "m-hub") for i in range(60)]
    edges = chain + star + [("s001", "m-hub"), ("m-hub", "s001"), ("x", "x")]
    assert run(spark, edges) == brute(edges)


def test_random_graphs(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(160)}", f"n{rnd.randrange(160)}") for _ in range(110)]
    assert run(spark, edges) == brute(edges)
