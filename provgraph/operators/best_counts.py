"""How often a step is the weakest of a best path, over all pairs, without an exchange of paths.

Paths of two steps are far more than links (by the number of links at a node in the middle), and each pair of
source and target has to see all of its paths. So what moves is links only: those of the first step are
written once to the shared folder, as lists by the node in the middle; those of the second step are spread and sorted
by target. A task takes its targets one after another, reads the lists of their links (mapped files, which
all tasks of a machine share) and keeps no paths but those of some targets at a time.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from provgraph.model import Profile, check_profile
from provgraph.operators.traverse import Graph, TypedGraph, best_paths, graph_paths, node_types, path_order, step_edges, to_known
from provgraph.runtime import shared_folder

#: A task holds about so many paths at a time, and a list is read in parts of at most so many links.
PATHS = 1_000_000
LIST_ROWS = 10_000
#: Confidences of up to 4 digits as whole numbers: their digits + SHIFT; ABSENT where there is none, which
#: the least of two passes over; 0 where both are absent.
DIGITS, SHIFT, ABSENT = 4, 10_000, 20_000
#: A source that is null; nulls are one source.
NO_SOURCE = -(2**63)
_BITS = ABSENT.bit_length()


def best_counts(graph: Graph, profile: Profile) -> DataFrame:
    """(weakest_step, confidence, n_pairs): the number of pairs whose best path (see `best_paths`) has this
    weakest step and confidence.

    Without an exchange of paths where the profile has two steps and ends of two types, in a typed graph whose confidences
    have up to 4 digits, and where the shared folder is mounted as a file system; else from `best_paths`.
    The lists are written when this is called; see `release`.
    """
    check_profile(profile)
    types = node_types(profile)
    if isinstance(graph, TypedGraph) and len(profile.steps) == 2 and types[0] != types[-1]:
        first, second = (step_edges(graph, profile, k) for k in (1, 2))
        folder = shared_folder(first.sparkSession).removeprefix("file://").removeprefix("file:")
        kinds = [first.schema["c1"].dataType, second.schema["c2"].dataType]
        if folder.startswith("/") and all(isinstance(t, DecimalType) and t.precision <= DIGITS for t in kinds) and kinds[0] == kinds[1]:
            return _by_lists(graph, profile, first, second, kinds[0], f"{folder}/lists-{uuid.uuid4().hex}")
    found = best_paths(graph_paths(graph, profile), profile, graph)
    return found.groupBy("weakest_step", "confidence").agg(F.count(F.lit(1)).alias("n_pairs"))


def _by_lists(graph: Graph, profile: Profile, first: DataFrame, second: DataFrame, kind: DecimalType, folder: str) -> DataFrame:
    def digits(c: str) -> Column:
        return F.coalesce((F.col(c) * F.lit(10**kind.scale)).cast("int") + F.lit(SHIFT), F.lit(ABSENT)).cast("int")

    first = to_known(first, graph, profile, 1).sortWithinPartitions("n1")
    first = first.select("n1", F.coalesce(F.col("n0").cast("long"), F.lit(NO_SOURCE)).alias("n0"), digits("c1").alias("c1"))
    os.makedirs(folder)
    n = sum(r.n for r in first.mapInArrow(lambda batches: write_lists(folder, batches), "n long").collect())  # a row a task

    # The window's order is that of the paths of a pair that are equally certain. That it needs all links of a target
    # in one task also keeps adaptive execution from splitting them.
    target = Window.partitionBy("n2").orderBy(*path_order(profile, graph))
    second = to_known(second.where("n1 IS NOT NULL"), graph, profile, 2).withColumn("rank", F.row_number().over(target))
    paths, list_rows = PATHS, LIST_ROWS
    found = second.select("n2", "n1", digits("c2").alias("c2"), "rank").mapInArrow(
        lambda batches: count_best(folder, n, batches, paths, list_rows), "weakest_step int, digits int, n long"
    )
    confidence = F.when(F.col("digits") > 0, ((F.col("digits") - SHIFT) * F.lit(f"1e-{kind.scale}").cast(kind)).cast(kind))
    return found.groupBy("weakest_step", confidence.alias("confidence")).agg(F.sum("n").alias("n_pairs"))


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def write_lists(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n1, n0, c1), equal n1 best side by side, as a folder of this task: nodes and confidences, and for each run of
    an n1 its length. A folder is there as a whole or not at all, whichever attempt wrote it."""
    task = TaskContext.get()
    own, runs, n = f"{folder}/.{task.partitionId()}-{task.taskAttemptId()}", [], 0
    os.makedirs(own)
    with open(f"{own}/nodes", "wb") as nodes, open(f"{own}/digits", "wb") as digits:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, c = _columns(batch)
            starts = np.flatnonzero(np.diff(key, prepend=key[0] + 1))
            runs.append(np.stack([key[starts], np.diff(starts, append=len(key))]))
            node.astype(np.int64, copy=False).tofile(nodes)
            c.astype(np.int16).tofile(digits)
            n += len(key)
    if n:
        np.save(f"{own}/runs.npy", np.concatenate(runs, axis=1))
        try:
            os.rename(own, f"{folder}/{task.partitionId()}")
        except OSError:
            if not os.path.isdir(f"{folder}/{task.partitionId()}"):
                raise
    shutil.rmtree(own, ignore_errors=True)
    yield pa.record_batch({"n": pa.array([n], pa.int64())})


def _repeated(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n[i] repetitions of i: i, and the number of the repetition from 0."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


class Lists:
    """What `write_lists` wrote: in order of `key`, where in which file a part of its list is."""

    def __init__(self, folder: str, n_links: int, list_rows: int):
        names = sorted(x for x in os.listdir(folder) if not x.startswith("."))
        self.nodes = [np.asarray(np.memmap(f"{folder}/{x}/nodes", np.int64, "r")) for x in names]
        self.digits = [np.asarray(np.memmap(f"{folder}/{x}/digits", np.int16, "r")) for x in names]
        if (n := sum(map(len, self.nodes))) != n_links:
            raise RuntimeError(f"{n} of {n_links} links are in {folder}: is spark.checkpoint.dir a folder that all executors share?")
        runs = [np.load(f"{folder}/{x}/runs.npy") for x in names]
        key, n = np.concatenate([np.empty((2, 0), np.int64), *runs], axis=1)
        start = np.concatenate([np.empty(0, np.int64), *(np.cumsum(r[1]) - r[1] for r in runs)])
        file = np.repeat(np.arange(len(names), dtype=np.int32), [r.shape[1] for r in runs])
        which, part = _repeated(-(-n // list_rows))
        start, n = start[which] + part * list_rows, np.minimum(n[which] - part * list_rows, list_rows)
        order = np.argsort(key[which], kind="stable")
        self.key, self.file, self.start, self.n = key[which][order], file[which][order], start[order], n[order]

    def pieces(self, target: np.ndarray, middle: np.ndarray, c: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
        """Links of the second step for each part of a list that they meet: target, c, rank, file, start, n."""
        at = np.searchsorted(self.key, middle)
        link, part = _repeated(np.searchsorted(self.key, middle, "right") - at)
        at = at[link] + part
        return [target[link], c[link], rank[link], self.file[at], self.start[at], self.n[at]]

    def paths(self, pieces: list[np.ndarray], classes: int = 1, mine: int = 0) -> list[np.ndarray]:
        """The paths of these pieces: number of the piece, source, its confidence; of `classes` of sources one."""
        file, start, n = pieces[3:]
        order = np.argsort(file, kind="stable")
        out = [[np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int16)]]
        for a, b in pairwise([*np.flatnonzero(np.diff(file[order], prepend=-1)), len(file)]):
            some, f = order[a:b], file[order[a]]
            which, at = _repeated(n[some])
            at += start[some][which]
            node, c, which = self.nodes[f][at], self.digits[f][at], some[which]
            if classes > 1:
                keep = node % classes == mine
                node, c, which = node[keep], c[keep], which[keep]
            out.append([which, node, c])
        return [np.concatenate(x) for x in zip(*out, strict=True)]


_lists = lru_cache(maxsize=1)(Lists)


def best_of(pieces: list[np.ndarray], piece: np.ndarray, source: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least confidence, weakest step) of the best path of each pair: highest confidence, then lowest rank."""
    if not len(piece):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    target = np.cumsum(np.diff(pieces[0], prepend=pieces[0][0]) != 0)
    last = pieces[1][piece]
    step, least = (c > last).astype(np.int64), np.minimum(c, last).astype(np.int64)
    least[least == ABSENT] = 0
    low, high = int(source.min()), int(source.max())
    if low == NO_SOURCE < high:
        none = source == NO_SOURCE
        low = int(source.min(where=~none, initial=high)) - 1
        source = np.where(none, low, source)
    ranks, span = int(pieces[2].max()).bit_length(), (high - low).bit_length()
    if int(target[-1]).bit_length() + span + _BITS + ranks + 1 <= 63:
        # All in one number: target, source, confidence from above, rank, step.
        base = (target << (span + _BITS + ranks + 1)) | (pieces[2] << 1)
        packed = base[piece] | ((source - low) << (_BITS + ranks + 1)) | ((ABSENT - least) << (ranks + 1)) | step
        packed.sort()
        best = packed[np.diff(packed >> (_BITS + ranks + 1), prepend=-1) != 0]
        return ABSENT - ((best >> (ranks + 1)) & ((1 << _BITS) - 1)), best & 1
    order = np.lexsort((pieces[2][piece], -least, source, target[piece]))
    pair = np.stack([target[piece], source])[:, order]
    best = order[np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(axis=0)]]
    return least[best], step[best]


def _blocks(n: np.ndarray, target: np.ndarray, paths: int) -> list[tuple[int, int]]:
    """Ranges of pieces: whole targets with about `paths` paths together, or one with more."""
    ends = np.flatnonzero(np.diff(target, append=target[-1] + 1)) + 1
    done = np.cumsum(n)[ends - 1]
    ends = ends[np.diff(done // paths, append=-1) != 0]
    return list(pairwise([0, *ends.tolist()]))


def count_best(folder: str, n_links: int, batches: Iterator[pa.RecordBatch], paths: int, list_rows: int) -> Iterator[pa.RecordBatch]:
    """(weakest_step, digits, n) of the pairs with these targets: (n2, n1, c2, rank), all of an n2 side by side."""
    lists, tally = _lists(folder, n_links, list_rows), np.zeros(2 * (ABSENT + 1), np.int64)

    def take(pieces: list[np.ndarray]) -> None:
        if not len(pieces[0]):
            return
        for a, b in _blocks(pieces[5], pieces[0], paths):
            block = [x[a:b] for x in pieces]
            classes = -(-int(block[5].sum()) // (3 * paths))
            for mine in range(classes):
                # Of a target with very many paths, a class of its sources at a time.
                parts = _blocks(block[5], np.arange(b - a), paths) if classes > 1 else [(0, b - a)]
                some = [(at, lists.paths([x[at:to] for x in block], classes, mine)) for at, to in parts]
                least, step = best_of(block, np.concatenate([p + at for at, (p, _, _) in some]), *(np.concatenate([x[i] for _, x in some]) for i in (1, 2)))
                tally[:] += np.bincount(2 * least + step, minlength=len(tally))

    waiting: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        target, middle, c, rank = _columns(batch)
        waiting.append(lists.pieces(target, middle, c.astype(np.int16), rank.astype(np.int64)))
        n += int(waiting[-1][5].sum())
        begun = next((w[0][0] for w in waiting if len(w[0])), None)
        if n >= paths and begun != target[-1]:
            pieces = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            whole = int(np.flatnonzero(pieces[0] != target[-1])[-1]) + 1  # the last target may go on
            take([x[:whole] for x in pieces])
            waiting = [[x[whole:] for x in pieces]]
            n = int(waiting[0][5].sum())
    if waiting:
        take([np.concatenate(x) for x in zip(*waiting, strict=True)])
    found = np.flatnonzero(tally)
    digits, step = found // 2, found % 2
    yield pa.record_batch({"weakest_step": pa.array(step.astype(np.int32), mask=digits == 0), "digits": pa.array(digits.astype(np.int32)), "n": pa.array(tally[found])})
