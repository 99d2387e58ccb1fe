"""Filling fixed-capacity containers with items: bound-certified repacking.

Items are spread over partitions by hash and packed there by best-fit decreasing. Dual-feasible
functions give a lower bound on the number of containers of each partition; a partition that meets
its bound is certified and closed. Partitions with a gap keep their well filled containers and give
the documents of the others to the next round, where they meet documents of other partitions and
are packed again, until every partition is certified or a round gains nothing.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.runtime import cut, ship

#: Items per partition: enough for tight packing, little for a task's memory.
PARTITION_ITEMS = 20_000
#: Containers filled at least so far stay closed when their partition has a gap.
WELL_FILLED = 0.995

#: Budgets of one call at most: they become an array beside each size.
MAX_BUDGETS = 1_000

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern of the byte-level BPE vocabularies.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) for every document; null and empty texts have 0 tokens.

    `tokenizer`: a file of byte-level BPE ranks that every worker can read.
    """

    ship(docs.sparkSession)
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer)
        for pdf in batches:
            sizes = [0 if not t else len(encoding.encode_ordinary(t)) for t in pdf[text]]
            yield pd.DataFrame({"doc_id": pdf[doc_id], "n_tokens": sizes})

    return docs.select(doc_id, text).mapInPandas(count, "doc_id long, n_tokens long")


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Least number of containers for items of `sizes` (each at most `capacity`, `counts` of each),
    by dual-feasible functions: the identity, the rounding family u_k, and the big-and-small family
    over all thresholds."""
    sizes = sizes.astype(np.int64)
    counts = np.ones(len(sizes), dtype=np.int64) if counts is None else counts.astype(np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    sizes, counts = sizes[order], counts[order]
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 25):
        scaled = sizes * (k + 1)
        # u_k(x) * k * capacity, kept whole: x * k where (k + 1) x is a multiple of the capacity,
        # else the floor of (k + 1) x / capacity, times the capacity.
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    total = np.concatenate([[0], np.cumsum(sizes * counts)])
    number = np.concatenate([[0], np.cumsum(counts)])
    half = int(np.searchsorted(sizes, capacity / 2, side="right"))
    low = np.unique(np.concatenate([[1], sizes[:half]]))
    big = np.searchsorted(sizes, capacity - low, side="right").clip(min=half)
    n_big, n_mid = number[-1] - number[big], number[big] - number[half]
    room = n_mid * capacity - (total[big] - total[half])
    small = total[half] - total[np.searchsorted(sizes, low, side="left").clip(max=half)]
    extra = np.maximum(0, -(-(small - room) // capacity))
    return max(best, int((n_big + n_mid + extra).max()))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; the fullest container with enough room is taken, the oldest
    of equals. Items without tokens go into the first container."""
    order = np.argsort(-sizes, kind="stable")
    where = np.zeros(len(sizes), dtype=np.int64)
    rooms: list[int] = []  # distinct free room, ascending
    bins_of: dict[int, list[int]] = {}
    n = 0
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            stack = bins_of[room]
            b = stack.pop()
            if not stack:
                del bins_of[room]
                rooms.pop(at)
        else:
            b, room = n, capacity
            n += 1
        where[i] = b
        room -= size
        if room in bins_of:
            bins_of[room].append(b)
        else:
            bins_of[room] = [b]
            insort(rooms, room)
    return where


def _pack_partition(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
    sizes = pdf["n_tokens"].to_numpy()
    where = best_fit_decreasing(sizes, capacity)
    load = np.bincount(where, weights=sizes).astype(np.int64)
    gap = len(load) - max(1, lower_bound(sizes, capacity))
    closed = np.ones(len(load), dtype=bool)
    if gap > 0:
        # The emptiest containers are given away: those not well filled, and enough to close the gap.
        fill = np.argsort(load, kind="stable")
        closed = load >= WELL_FILLED * capacity
        closed[fill[: 2 * gap]] = False
    return pdf.assign(bin=where, closed=closed[where], gap=gap)


_PACKED = "budget_id int, capacity int, doc_id long, piece int, n_tokens long, part long, bin long, closed boolean, gap long"


def pack(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, doc_id, piece, first_token, n_tokens, container) for each document and budget.

    `sizes`: doc_id, n_tokens; `budgets`: budget_id, capacity_tokens. A document is one piece, or,
    if longer than the capacity, pieces of exactly the capacity and one of the rest; such a full
    piece fills a container of its own. Documents without tokens lie in a container too. Budgets
    without a positive capacity give no rows. A container is named by budget, round, partition and
    number; the result is the same for the same rows.
    """
    ship(sizes.sparkSession)
    # The budgets are settings, a handful of rows; an array of them is exploded beside each size.
    settings = budgets.where("capacity_tokens > 0").select("budget_id", F.col("capacity_tokens").cast("int").alias("capacity")).limit(MAX_BUDGETS + 1).collect()
    if len(settings) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets; pack them in several calls")
    if not settings:
        settings_of_item = F.array().cast("array<struct<budget_id:int,capacity:int>>")
    else:
        settings_of_item = F.array(*(F.struct(F.lit(b).alias("budget_id"), F.lit(c).alias("capacity")) for b, c in settings))
    items = sizes.select("doc_id", "n_tokens", F.inline(settings_of_item))
    whole = (F.col("n_tokens") / F.col("capacity")).cast("int")
    rest = F.col("n_tokens") - whole * F.col("capacity")
    full = items.where(whole > 0).select(
        "budget_id", "doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"), "capacity"
    )
    full = full.select(
        "budget_id", "doc_id", "piece", (F.col("piece").cast("long") * F.col("capacity")).alias("first_token"),
        F.col("capacity").cast("long").alias("n_tokens"),
        F.concat_ws("-", "budget_id", F.lit("full"), "doc_id", "piece").alias("container"),
    )
    open_items = cut(
        items.where((whole == 0) | (rest > 0)).select("budget_id", "capacity", "doc_id", whole.alias("piece"), rest.alias("n_tokens"))
    )
    results = [full]
    round_no, last, previous = 0, None, None
    while True:
        counts = {r.budget_id: (r.n, r.bins) for r in _tally(open_items).collect()}
        if not counts:
            break
        parts = F.create_map(*[F.lit(x) for b, (n, _) in counts.items() for x in (b, -(-n // PARTITION_ITEMS))])
        part = F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_no)), parts[F.col("budget_id")])
        packed = cut(
            open_items.select("budget_id", "capacity", "doc_id", "piece", "n_tokens")
            .withColumn("part", part)
            .groupBy("budget_id", "part")
            .applyInPandas(_pack_partition, _PACKED)
        )
        bins = {r.budget_id: r.bins for r in _tally(packed).collect()}
        if last is not None:
            # A budget whose pool needs as many containers as before is left as the last round had it.
            worse = [b for b in bins if bins[b] >= last[b]]
            if worse:
                results.append(_named(previous.where(F.col("budget_id").isin(worse)), round_no - 1))
                packed = packed.where(~F.col("budget_id").isin(worse))
        results.append(_named(packed.where("closed"), round_no))
        previous = packed.where("not closed")
        last = {r.budget_id: r.bins for r in _tally(previous).collect()}
        open_items = previous
        round_no += 1
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _tally(items: DataFrame) -> DataFrame:
    bins = F.count_distinct("part", "bin") if "bin" in items.columns else F.lit(0)
    return items.groupBy("budget_id").agg(F.count(F.lit(1)).alias("n"), bins.alias("bins"))


def _named(packed: DataFrame, round_no: int) -> DataFrame:
    return packed.select(
        "budget_id", "doc_id", "piece", (F.col("piece").cast("long") * F.col("capacity")).alias("first_token"), "n_tokens",
        F.concat_ws("-", "budget_id", F.lit(f"r{round_no}"), "part", "bin").alias("container"),
    )


def packing_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: containers used, the lower bound on their number (dual-feasible functions over
    all pieces together), documents, pieces, tokens and the share of space that is filled."""
    used = packed.groupBy("budget_id").agg(
        F.count_distinct("container").alias("n_containers"), F.count_distinct("doc_id").alias("n_docs"),
        F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"),
    ).join(budgets.select("budget_id", "capacity_tokens"), "budget_id")
    ship(packed.sparkSession)
    # A histogram of sizes has at most as many rows as the capacity.
    sizes = packed.groupBy("budget_id", F.col("n_tokens").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.join(budgets.select("budget_id", "capacity_tokens"), "budget_id")

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        least = lower_bound(pdf["size"].to_numpy(), int(pdf["capacity_tokens"].iloc[0]), pdf["n"].to_numpy())
        return pd.DataFrame({"budget_id": pdf["budget_id"].iloc[:1], "lower_bound": [least]})

    bounds = sizes.groupBy("budget_id").applyInPandas(bound, "budget_id int, lower_bound long")
    filled = F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))
    return used.join(bounds, "budget_id").withColumn("filled", F.round(filled, 4))
