"""Consolidating pairwise matches into groups: deterministic Boruvka hooking.

Each round every component selects its smallest outgoing edge. Edges are ordered by (smaller end,
larger end), so a component's smallest edge leads to its smallest neighbour, and the only cycles
are pairs that select each other; there the smaller end becomes the root. Trees collapse by pointer
doubling, edges are relabelled by root and deduplicated, until none remain. The number of components
with edges at least halves per round. All state is distributed and stored after each step; hubs are handled by
map-side combined minima and salted joins. Frames of fewer rows than a hot key has (skew.HOT_ROWS) hold
no hot key, so they aren't probed, and some of their stored tables are left out: this saves jobs on small
inputs and changes no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.functions import skew
from provgraph.functions.skew import hot_keys, salted_join
from provgraph.runtime import stored


def _hot(df: DataFrame, keys: list[str], n_rows: int) -> DataFrame | None:
    """Hot keys of a frame of `n_rows` rows; too few rows for any are not looked at."""
    return hot_keys(df, keys) if n_rows >= skew.HOT_ROWS else None


def _follow(pointers: DataFrame, to: DataFrame, n_rows: int) -> DataFrame:
    """(a, p, pp): each pointer a -> p with the pointer of p in `to`, null if it has none."""
    right = to.select(F.col("a").alias("p"), F.col("p").alias("pp"))
    return salted_join(pointers, right, ["p"], "a", _hot(pointers, ["p"], n_rows), "left")


def _hook(edges: DataFrame, n_edges: int) -> DataFrame:
    """(a, p): for each component with edges, the root of the tree it is hooked to."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parent = both.groupBy("a").agg(F.min("b").alias("p"))
    mutual = F.when(F.col("pp") == F.col("a"), F.least("a", "p")).otherwise(F.col("pp"))
    n_ends = 2 * n_edges  # at least the number of pointers
    pointers = stored(_follow(parent, parent, n_ends).select("a", mutual.alias("p")))
    while True:
        # Two doublings per round trip; where the second moves nothing all pointers are at roots.
        twice = _follow(pointers, pointers, n_ends).select("a", F.col("pp").alias("p"))
        if n_ends >= skew.HOT_ROWS:
            twice = stored(twice)
        step = stored(_follow(twice, twice, n_ends).select("a", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
        pointers = step.select("a", "p")
        if not step.agg(F.max("moved")).head()[0]:
            return pointers


def _relabel(edges: DataFrame, roots: DataFrame, n_edges: int) -> DataFrame:
    for end, other in (("a", "b"), ("b", "a")):
        right = roots.select(F.col("a").alias(end), F.col("p").alias("_root"))
        edges = salted_join(edges, right, [end], other, _hot(edges, [end], n_edges)).drop(end)
        edges = edges.withColumnRenamed("_root", end)
    return _ordered(edges)


def _ordered(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, group_id) for every id of `edges` (columns a, b) that is tied to another one.

    group_id is the smallest id of the group. Direction and repetition of edges don't matter; edges
    with a null end and edges from an id to itself tie nothing. No edges give an empty result.
    """
    edges = stored(_ordered(edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())))
    label: DataFrame | None = None
    n_edges = n_first = edges.count()
    while n_edges:
        roots = _hook(edges, n_edges)
        if label is None:
            label = roots
        else:
            label = _follow(label, roots, 2 * n_first).select("a", F.coalesce("pp", "p").alias("p"))
            if n_first >= skew.HOT_ROWS:
                label = stored(label)
        edges = stored(_relabel(edges, roots, n_edges))
        n_edges = edges.count()
    if label is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    least = label.groupBy("p").agg(F.min("a").alias("group_id"))
    return salted_join(label, least, ["p"], "a", _hot(label, ["p"], 2 * n_first)).select(F.col("a").alias("id"), "group_id")
