"""Fixed-pattern path traversal with weakest-link confidence.

A profile of k steps becomes k equi-joins; there is no recursion. A path's confidence is the minimum
over its steps, a target's the maximum over its paths. Paths are walks: a step may come back to a
node or cross a link again; only the terminal must differ from the source.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provgraph.model import Profile, check_profile, type_after
from provgraph.runtime import broadcast_if_small


class UnknownObject(LookupError):
    """There is no object of this id, or it is of another type."""


class MergedObject(LookupError):
    """The object was merged into another one."""


def require_object(objects: DataFrame, object_id: str, object_type: str, refuse_merged: bool = False) -> None:
    """Raise UnknownObject for an absent id or another type, then MergedObject for a tombstone."""
    row = objects.where(F.col("id") == object_id).select("object_type", "merged_into_id").head()
    if row is None or row.object_type != object_type:
        raise UnknownObject(f"{object_type} {object_id}")
    if refuse_merged and row.merged_into_id is not None:
        raise MergedObject(f"{object_id} is merged into {row.merged_into_id}")


class TableGraph:
    """A graph in the generic tables: `links` (id, link_type, from_id, to_id, confidence) and `objects` (id,
    object_type). Nodes are known by their ids."""

    def __init__(self, links: DataFrame, objects: DataFrame):
        self.links, self.objects = links, objects

    def edges(self, link_type: str) -> DataFrame:
        """(source, target, confidence, link_id) of a link type."""
        mine = self.links.where(F.col("link_type") == link_type)
        return mine.select(F.col("from_id").alias("source"), F.col("to_id").alias("target"), "confidence", F.col("id").alias("link_id"))

    def nodes(self, object_type: str, terminal: bool) -> DataFrame:
        """(node) of a type; on the way to the end any object will do."""
        return (self.objects.where(F.col("object_type") == object_type) if terminal else self.objects).select(F.col("id").alias("node"))

    def n_ends(self, object_type: str, link_type: str, end: str) -> int:
        """About how many nodes are at an end (source or target) of a link type."""
        return self.edges(link_type).agg(F.approx_count_distinct(end)).head()[0]

    def key(self, object_type: str, object_id: str) -> object:
        return object_id

    def name(self, object_type: str, node: Column) -> Column:
        return node


class TypedGraph:
    """A graph in tables of its own for each type: `edges` (link type -> a function that gives source, target,
    confidence) and `nodes` (object type -> node, prefix of the ids). Nodes are known by whole-number keys, which shuffle
    and compare faster than ids; ids are made at the end, as prefix and key."""

    def __init__(self, edges: dict[str, Callable[[], DataFrame]], nodes: dict[str, tuple[DataFrame, str]]):
        self._edges, self._nodes = edges, nodes

    def edges(self, link_type: str) -> DataFrame:
        return self._edges[link_type]()

    def nodes(self, object_type: str, terminal: bool) -> DataFrame:
        return self._nodes[object_type][0]

    def n_ends(self, object_type: str, link_type: str, end: str) -> int:
        return self._nodes[object_type][0].count()

    def key(self, object_type: str, object_id: str) -> object:
        """The key in an id of this type, or None if it can't be one."""
        prefix = self._nodes[object_type][1]
        digits = object_id.removeprefix(prefix)
        return int(digits) if object_id.startswith(prefix) and digits.isascii() and digits.isdigit() and str(int(digits)) == digits else None

    def name(self, object_type: str, node: Column) -> Column:
        return F.concat(F.lit(self._nodes[object_type][1]), node.cast("string"))


Graph = TableGraph | TypedGraph
#: Up to this number of results a task combines, the last step is combined in as few tasks as there are cores.
COMBINED = 10_000_000
#: Nodes reached from one source are broadcast to the next step's edges up to this number.
REACHED = 100_000


def node_types(profile: Profile) -> list[str]:
    """The object types of n0..nk."""
    out = [profile.source()]
    for step in profile.steps:
        out.append(type_after(out[-1], step))
    return out


def step_edges(graph: Graph, profile: Profile, k: int) -> DataFrame:
    """The edges of the k-th step in its direction: n{k-1}, n{k}, c{k} and, where the graph has link ids, l{k}."""
    step = profile.steps[k - 1]
    start, end = ("source", "target") if step.direction == "ALONG" else ("target", "source")
    edges = graph.edges(step.link_type)
    columns = {start: f"n{k - 1}", end: f"n{k}", "confidence": f"c{k}", "link_id": f"l{k}"}
    return edges.select(*(F.col(c).alias(n) for c, n in columns.items() if c in edges.columns))


def to_known(edges: DataFrame, graph: Graph, profile: Profile, k: int) -> DataFrame:
    """The edges of the k-th step whose end is there and, if it is the terminal, of the profile's type."""
    known = graph.nodes(node_types(profile)[k], k == len(profile.steps)).select(F.col("node").alias(f"n{k}"))
    return edges.join(known, f"n{k}", "left_semi")


def graph_paths(graph: Graph, profile: Profile, source_id: str | None = None) -> DataFrame:
    """All paths of `profile`: n0..nk (nodes as the graph knows them), c1..ck (confidences) and, where the
    graph has link ids, l1..lk.

    Every node must be there, the terminal one of the profile's type. With `source_id` only its
    paths: the filter reaches the scan of the first step, and the edges of later steps are reduced
    to the nodes reached (broadcast if few) before anything else is done with them. Paths through
    hot nodes are many however they are joined; adaptive execution splits both sides of such joins.
    """
    check_profile(profile)
    types = node_types(profile)
    out: DataFrame | None = None
    for k in _numbers(profile):
        edges = step_edges(graph, profile, k)
        if source_id is not None:
            if out is None:
                edges = edges.where(F.col("n0") == F.lit(graph.key(types[0], source_id)))
            else:
                reached = broadcast_if_small(out.select(f"n{k - 1}").distinct(), REACHED)
                edges = edges.join(reached, f"n{k - 1}", "left_semi")
        # Ends are checked on the edges, of which there are far fewer than paths.
        edges = to_known(edges, graph, profile, k)
        out = edges if out is None else out.join(edges, f"n{k - 1}")
    end = f"n{len(profile.steps)}"
    return out.where(F.col(end) != F.col("n0")) if types[0] == types[-1] else out


def paths(links: DataFrame, objects: DataFrame, profile: Profile, source_id: str | None = None) -> DataFrame:
    """`graph_paths` over the generic tables."""
    return graph_paths(TableGraph(links, objects), profile, source_id)


def named(found: DataFrame, graph: Graph, profile: Profile) -> DataFrame:
    """Paths (or best paths) of a typed graph with ids instead of keys, link ids included."""
    if isinstance(graph, TableGraph):
        return found
    types = node_types(profile)
    out = found.withColumns({f"n{k}": graph.name(t, F.col(f"n{k}")) for k, t in enumerate(types)})
    ends = {k: (k - 1, k) if s.direction == "ALONG" else (k, k - 1) for k, s in enumerate(profile.steps, 1)}
    out = out.withColumns({f"l{k}": F.concat_ws("|", F.lit(profile.steps[k - 1].link_type), f"n{a}", f"n{b}") for k, (a, b) in ends.items()})
    return out.withColumns({c: F.col(n) for c, n in (("source_id", "n0"), ("target_id", f"n{len(profile.steps)}")) if c in found.columns})


def _numbers(profile: Profile) -> range:
    return range(1, len(profile.steps) + 1)


def path_confidence(profile: Profile) -> Column:
    """The minimum over the steps."""
    cs = [F.col(f"c{k}") for k in _numbers(profile)]
    return F.least(*cs) if len(cs) > 1 else cs[0]


def weakest_step(profile: Profile) -> Column:
    """The place (from 0) of the first step with the least confidence."""
    least = path_confidence(profile)
    return reduce(lambda e, k: F.when(F.col(f"c{k}") == least, F.lit(k - 1)).otherwise(e), reversed(_numbers(profile)), F.lit(None).cast("int"))


def signature(profile: Profile) -> Column:
    """type:direction:node of each step, joined by '>': the last criterion between equal paths."""
    parts = [F.concat(F.lit(f"{s.link_type}:{s.direction}:"), F.col(f"n{k}")) for k, s in enumerate(profile.steps, 1)]
    return F.concat_ws(">", *parts)


def target_scores(found: DataFrame, profile: Profile) -> DataFrame:
    """(source_id, target_id, confidence, path_count) by partial aggregation, without best paths."""
    return found.groupBy(F.col("n0").alias("source_id"), F.col(f"n{len(profile.steps)}").alias("target_id")).agg(
        F.max(path_confidence(profile)).alias("confidence"), F.count(F.lit(1)).alias("path_count")
    )


def path_order(profile: Profile, graph: Graph | None) -> list[Column]:
    """What decides between equally certain paths of one pair: the signature without the last step, which
    all paths of the pair have in common."""
    types = node_types(profile)
    name = (lambda k: F.col(f"n{k}")) if graph is None else (lambda k: graph.name(types[k], F.col(f"n{k}")))
    parts = [F.concat(F.lit(f"{s.link_type}:{s.direction}:"), name(k), F.lit(">")) for k, s in enumerate(profile.steps[:-1], 1)]
    return [F.concat(*parts)] if parts else []


def best_paths(found: DataFrame, profile: Profile, graph: Graph | None = None) -> DataFrame:
    """The best path of each (source, target) with confidence, path_count and weakest_step.

    Better is: higher confidence, fewer steps (all have the profile's), smaller signature. Paths meet
    in one shuffle and are sorted once: ranks and counts use the same order. `graph` is needed for
    paths of a typed graph, whose nodes come out as keys (see `named`).
    """
    k = len(profile.steps)
    scored = found.withColumn("confidence", path_confidence(profile))
    pair = Window.partitionBy("n0", f"n{k}")
    order = [F.desc("confidence"), *(F.asc(c) for c in path_order(profile, graph))]
    ranked = scored.withColumn("_rn", F.row_number().over(pair.orderBy(*order))).withColumn("path_count", F.count(F.lit(1)).over(pair))
    best = ranked.where("_rn = 1").drop("_rn")
    return best.withColumns({"weakest_step": weakest_step(profile), "source_id": F.col("n0"), "target_id": F.col(f"n{k}")})


def traverse_graph(graph: Graph, profile: Profile, source_id: str) -> DataFrame:
    """Best paths from one source in target order (confidence down, steps, target id), with ids.

    Raises UnknownObject where the source isn't there; no path gives an empty frame. Merged
    objects can be traversed.
    """
    source, at = profile.source(), graph.key(profile.source(), source_id)
    if at is None or graph.nodes(source, True).where(F.col("node") == F.lit(at)).isEmpty():
        raise UnknownObject(f"{source} {source_id}")
    found = best_paths(graph_paths(graph, profile, source_id), profile, graph)
    return named(found, graph, profile).orderBy(F.desc("confidence"), "target_id")


def traverse(links: DataFrame, objects: DataFrame, profile: Profile, source_id: str) -> DataFrame:
    """`traverse_graph` over the generic tables."""
    return traverse_graph(TableGraph(links, objects), profile, source_id)


def steps_array(profile: Profile) -> Column:
    """The path as an array of steps (link_id, link_type, direction, confidence, to)."""
    return F.array(
        *(
            F.struct(
                F.col(f"l{k}").alias("link_id"), F.lit(s.link_type).alias("link_type"), F.lit(s.direction).alias("direction"),
                F.col(f"c{k}").alias("confidence"), F.col(f"n{k}").alias("to"),
            )
            for k, s in enumerate(profile.steps, 1)
        )
    )


def weakest_link(profile: Profile) -> Column:
    """The step of `steps_array` that is the weakest (needs the column weakest_step)."""
    return F.get(steps_array(profile), F.col("weakest_step"))


def canonical_results(best: DataFrame, profile: Profile) -> DataFrame:
    """(source_id, target_id, result): each best path as JSON with all that the answer depends on; link
    ids, which the storage assigns, are left out, so that two stores can be compared."""
    steps = F.transform(steps_array(profile), lambda s: F.struct(s["link_type"].alias("link_type"), s["direction"].alias("direction"), s["confidence"].alias("confidence"), s["to"].alias("to")))
    result = F.struct(
        F.lit(profile.name).alias("profile"), F.col("target_id").alias("target"), "confidence", "path_count",
        F.struct(F.col("source_id").alias("from"), F.col("weakest_step").alias("weakest_step_index"), steps.alias("steps")).alias("best_path"),
    )
    return best.select("source_id", "target_id", F.to_json(result).alias("result"))


def shared_prefix(best: DataFrame, profile: Profile) -> DataFrame:
    """Per source: how many leading steps all its best paths share (links apart), and whether they
    all have the same weakest link within those."""
    same = [F.count_distinct(F.struct(f"c{k}", f"n{k}")) == 1 for k in _numbers(profile)]
    weak = F.coalesce(*(F.when(F.col("weakest_step") == k - 1, F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("c"), F.col(f"n{k}").alias("n"))) for k in _numbers(profile)))
    out = best.withColumn("_w", weak).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_targets"), F.count_distinct("_w").alias("_weak"), F.max("weakest_step").alias("_at"),
        *(s.alias(f"_same{k}") for k, s in zip(_numbers(profile), same, strict=True)),
    )
    length = F.lit(0)
    for k in reversed(_numbers(profile)):
        length = F.when(F.col(f"_same{k}"), 1 + length).otherwise(0)
    out = out.withColumn("prefix_length", length)
    return out.select(
        "source_id", "n_targets", "prefix_length", ((F.col("_weak") == 1) & (F.col("_at") < F.col("prefix_length"))).alias("one_weakest_link")
    )


def bottleneck_of_graph(graph: Graph, profile: Profile) -> DataFrame:
    """(source_id, target_id, confidence, path_count) without materialising paths: between steps
    equal (first, node) rows are combined (max of min, counts summed), which the semiring of
    weakest links allows. It begins at the end of the path with fewer nodes, as what is carried from
    step to step has at most a row for each of them and each node reached. Each task of the last step sends on up to
    all results; where a task can hold them, one task for each core combines all it gets before it does. For long
    profiles; edges are taken as they are, without node checks."""
    types = node_types(profile)
    steps = [(s.link_type, *(("source", "target") if s.direction == "ALONG" else ("target", "source"))) for s in profile.steps]
    (first, start, _), (last, _, end) = steps[0], steps[-1]
    n_first, n_last = graph.n_ends(types[0], first, start), graph.n_ends(types[-1], last, end)
    backward = n_last < n_first
    out: DataFrame | None = None
    for k, (link_type, start, end) in enumerate([(t, b, a) for t, a, b in reversed(steps)] if backward else steps, 1):
        edges = graph.edges(link_type).select(F.col(start).alias("node"), F.col(end).alias("next"), F.col("confidence").alias("c"))
        if out is None:
            out = edges.select(F.col("node").alias("first"), F.col("next").alias("node"), F.col("c").alias("confidence"), F.lit(1).cast("long").alias("path_count"))
            continue
        stepped = out.join(edges, "node").select("first", F.col("next").alias("node"), F.least("confidence", "c").alias("c"), F.col("path_count").alias("n"))
        if k == len(steps) and n_first * n_last <= COMBINED:
            stepped = stepped.coalesce(edges.sparkSession.sparkContext.defaultParallelism)
        out = stepped.groupBy("first", "node").agg(F.max("c").alias("confidence"), F.sum("n").alias("path_count"))
    if len(steps) == 1:
        out = out.groupBy("first", "node").agg(F.max("confidence").alias("confidence"), F.sum("path_count").alias("path_count"))
    out = out.where("first <> node") if types[0] == types[-1] else out
    source, target = ("node", "first") if backward else ("first", "node")
    return out.select(graph.name(types[0], F.col(source)).alias("source_id"), graph.name(types[-1], F.col(target)).alias("target_id"), "confidence", "path_count")


def bottleneck_scores(links: DataFrame, profile: Profile) -> DataFrame:
    """`bottleneck_of_graph` over the generic links."""
    return bottleneck_of_graph(TableGraph(links, links), profile)


def risk_report(best: DataFrame, profile: Profile, names: DataFrame) -> DataFrame:
    """Best paths as text, one line per target in target order: name, confidence with all its
    decimals, number of routes, the route with names, and its weakest link marked.

    `names` (id, name) is joined only to the nodes shown; a node without a name shows its id.
    """
    steps = F.posexplode(steps_array(profile)).alias("k", "step")
    shown = best.select("source_id", "target_id", "confidence", "path_count", "weakest_step", steps)
    named = shown.join(names.select(F.col("id").alias("_id"), "name"), F.col("step.to") == F.col("_id"), "left")
    label = F.concat(
        F.coalesce("name", "step.to"), F.lit(" ("), F.col("step.confidence").cast("string"), F.lit(")"),
        F.when(F.col("k") == F.col("weakest_step"), "*").otherwise(""),
    )
    lines = named.groupBy("source_id", "target_id", "confidence", "path_count").agg(
        F.sort_array(F.collect_list(F.struct("k", label.alias("label"), F.coalesce("name", "step.to").alias("node")))).alias("route")
    )
    return lines.select(
        "source_id", "target_id", F.element_at("route", -1)["node"].alias("target"),
        F.col("confidence").cast("string").alias("confidence"), "path_count",
        F.array_join(F.transform("route", lambda x: x["label"]), " > ").alias("route"),
    )
