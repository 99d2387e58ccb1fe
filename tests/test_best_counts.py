"""Counts over best paths without an exchange of paths equal those of the best paths themselves."""

import os
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from provgraph import model
from provgraph.operators import best_counts as B
from provgraph.operators import traverse as T
from tests.conftest import DATA, rows

RISK = model.SUPPLIER_DEVICE_RISK


def typed(spark, supplies, composed, parts=None, devices=None):
    """A graph of (supplier, part, confidence) and (device, part, confidence); all ends are there unless said."""
    frame = lambda e: lambda: spark.createDataFrame([(a, b, None if c is None else Decimal(c).scaleb(-3)) for a, b, c in e], "source long, target long, confidence decimal(4,3)")
    nodes = lambda ids: spark.createDataFrame([(i,) for i in sorted(ids)], "node long")
    parts = {b for _, b, _ in supplies} if parts is None else parts
    devices = {a for a, _, _ in composed if a is not None} if devices is None else devices
    return T.TypedGraph({"SUPPLIES": frame(supplies), "COMPOSED_OF": frame(composed)}, {"PART": (nodes(p for p in parts if p is not None), "PART-"), "DEVICE": (nodes(devices), "DEV-")})


def want(graph, profile=RISK):
    best = T.best_paths(T.graph_paths(graph, profile), profile, graph)
    return rows(best.groupBy("weakest_step", "confidence").agg(F.count(F.lit(1)).alias("n_pairs")))


def some_graph(spark, **known):
    """Few confidences, so many ties; suppliers of part 7 and parts of device 3 are many."""
    rng = np.random.default_rng(5)
    supplies = {(int(s), int(p)): int(c) for s, p, c in zip(rng.integers(0, 40, 900), rng.integers(0, 30, 900), rng.integers(500, 505, 900), strict=True)}
    supplies |= {(s, 7): 500 + s % 4 for s in range(60)}
    composed = {(int(d), int(p)): int(c) for d, p, c in zip(rng.integers(0, 50, 200), rng.integers(0, 33, 200), rng.integers(500, 505, 200), strict=True)}
    composed |= {(3, p): 502 for p in range(30)}
    return typed(spark, [(*k, c) for k, c in supplies.items()], [(*k, c) for k, c in composed.items()], **known)


@pytest.mark.parametrize("paths,part", [(1_000_000, 10_000), (40, 10_000), (10, 3)])
def test_equals_best_paths(spark, monkeypatch, paths, part):
    monkeypatch.setattr(B, "PATHS", paths)
    monkeypatch.setattr(B, "LIST_ROWS", part)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        graph = some_graph(spark)
        assert rows(B.best_counts(graph, RISK)) == want(graph)
        graph = some_graph(spark, parts=set(range(20)), devices=set(range(30)))
        assert rows(B.best_counts(graph, RISK)) == want(graph) != []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_by_name_of_the_part(spark):
    """PART-10> stands before PART-1>: the weakest step is that of part 10."""
    graph = typed(spark, [(0, 1, 500), (0, 10, 600)], [(5, 1, 600), (5, 10, 500)])
    assert rows(B.best_counts(graph, RISK)) == [(1, Decimal("0.500"), 1)] == want(graph)


def test_odd_rows(spark):
    """No source (one source of its own), no confidence, no part, no device, keys far apart, nothing at all."""
    far = [(-(2**62), 1, 700), (2**62, 1, 300), (2**62, 2, 800)]
    supplies = [*far, (None, 1, None), (None, 2, 900), (4, 1, -200), (4, None, 100), (6, 9, 100)]
    composed = [(1, 1, 600), (1, 2, None), (2, 2, 650), (3, None, 100), (None, 1, 100), (4, 8, 100)]
    for a in (supplies, supplies[3:]):
        graph = typed(spark, a, composed)
        assert rows(B.best_counts(graph, RISK)) == want(graph)
    assert B.best_counts(typed(spark, [], []), RISK).collect() == []


def test_lists_that_are_not_all_there(tmp_path):
    with pytest.raises(RuntimeError, match="0 of 5 links"):
        B.Lists(str(tmp_path), 5, 10)


def test_best_of_a_block():
    """In one number or, where keys are too far apart for it, by their columns."""
    rng = np.random.default_rng(1)
    pieces = [np.sort(rng.integers(0, 9, 60)), rng.integers(1, 6, 60).astype(np.int16), np.arange(60) + 1]
    near, far = np.arange(8), np.array([0, 2**60, -(2**61), 5, B.NO_SOURCE])
    for sources in (near, far):
        piece, source = (x.ravel() for x in np.meshgrid(np.arange(60), sources))
        keep = rng.random(len(piece)) < 0.5
        piece, source, c = piece[keep], source[keep], rng.integers(1, 6, keep.sum()).astype(np.int16)
        best = {}
        for p, s, x in zip(piece.tolist(), source.tolist(), c.tolist(), strict=True):
            y = int(pieces[1][p])
            best.setdefault((int(pieces[0][p]), s), []).append((-min(x, y), int(pieces[2][p]), int(x > y)))
        expected = Counter((-least, step) for least, _, step in map(min, best.values()))
        assert Counter(zip(*(x.tolist() for x in B.best_of(pieces, piece, source, c)), strict=True)) == expected


def test_other_profiles_go_by_best_paths(spark):
    """As one of a single step does."""
    parts = model.Profile((model.Step("COMPOSED_OF"),), "PART", "PARTS")
    graph = some_graph(spark)
    assert rows(B.best_counts(graph, parts)) == want(graph, parts) != []


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test data")
def test_histogram_exchanges_links_only(spark):
    """No frame of paths is made by a join in Spark, so none is exchanged."""
    plan = entry.queries()["d3_weakest_step_histogram"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Join LeftSemi" in plan
