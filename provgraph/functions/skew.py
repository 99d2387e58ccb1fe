"""Joins that stay balanced when single keys hold a large share of the rows.

Every key is split by its own number of rows, so no task gets more than a fixed number of a key's
rows: there is no limit on how many keys are split. The table of the split keys is broadcast only
where it is known to be small, else it is joined by shuffle. Where a frame may have as many rows as the input, its
join is hinted (`by_shuffle`): behind Python steps and exploded lists Spark's estimates, which a checkpoint keeps, are
far too small, and a broadcast chosen by them passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.runtime import cut

#: A linear join gives no task more than so many rows of one key.
HOT_ROWS = 100_000
#: Where rows of one key meet each other, a task compares at most a block of so many rows with another one.
ROWS_PER_BLOCK = 2_000
#: A table of split keys with at most so many rows is broadcast.
BROADCAST_KEYS = 100_000
#: A table of split keys with at most so many rows passes through the driver instead of a checkpoint.
_DRIVER_KEYS = 1_000


def _blocks(n: Column, rows: int) -> Column:
    return F.ceil(n / F.lit(rows)).cast("int")


def _materialised(hot: DataFrame) -> DataFrame | None:
    """`hot` computed once, with a broadcast hint if it is small; None if it has no rows. At most
    _DRIVER_KEYS + 1 rows reach the driver."""
    # Ordered, as a plain limit looks for rows in job after job while there are none.
    rows = hot.orderBy(*hot.columns).limit(_DRIVER_KEYS + 1).collect()
    if not rows:
        return None
    if len(rows) <= _DRIVER_KEYS:
        return F.broadcast(hot.sparkSession.createDataFrame(rows, hot.schema))
    hot = cut(hot)
    return F.broadcast(hot) if hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else by_shuffle(hot)


def by_shuffle(df: DataFrame) -> DataFrame:
    """`df` with the hint that its next join is not to be a broadcast, whatever size is estimated."""
    return df.hint("merge")


def hot_keys(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame | None:
    """(keys, _splits) of the keys with more than HOT_ROWS rows, or None if there are none (one
    job). `weight`: a column that already holds the number of rows of each key. Where `df` is costly
    it should be materialised before."""
    if weight is None:
        weight = "_n"
        df = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(weight))
    hot = df.where(F.col(weight) > HOT_ROWS).select(*keys, _blocks(F.col(weight), HOT_ROWS).alias("_splits"))
    return _materialised(hot)


def _block_of(spread: str, splits: Column) -> Column:
    """The block of a row: from the hash of `spread`, so that a recomputed task gives the same rows."""
    return F.pmod(F.xxhash64(F.col(spread)), splits).cast("int")


def _range(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, hot: DataFrame | None, how: str = "inner", large: bool = False) -> DataFrame:
    """Equi-join of a skewed `left` with a `right` that has few rows per key.

    Rows of hot keys (see `hot_keys`) get a salt from the hash of `spread`; the few right rows of hot
    keys are repeated for each salt. Without hot keys it is a plain join. `how` is 'inner' or 'left'.
    `large`: both sides may be as large as the input and are never broadcast. Null keys match nothing.
    """
    last = by_shuffle if large else lambda df: df
    if hot is None:
        return left.join(last(right), keys, how)
    one = F.coalesce("_splits", F.lit(1))
    lhs = left.join(hot, keys, "left").withColumn("_salt", _block_of(spread, one))
    rhs = right.join(hot, keys, "left").withColumn("_salt", F.explode(_range(one)))
    return lhs.drop("_splits").join(last(rhs.drop("_splits")), [*keys, "_salt"], how).drop("_salt")


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], spread_left: str, spread_right: str) -> DataFrame:
    """Inner equi-join where both sides may hold many rows of a key: a key with m and n rows and more
    than HOT_ROWS results becomes a grid of cells, none with more than a block of each side."""
    sizes = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_m"), (right, "_n"))]
    both = sizes[0].join(sizes[1], keys).where(F.col("_m") * F.col("_n") > HOT_ROWS)
    hot = _materialised(both.select(*keys, _blocks(F.col("_m"), ROWS_PER_BLOCK).alias("_rows"), _blocks(F.col("_n"), ROWS_PER_BLOCK).alias("_cols")))
    if hot is None:
        return left.join(right, keys)
    n_rows, n_cols = F.coalesce("_rows", F.lit(1)), F.coalesce("_cols", F.lit(1))
    lhs = left.join(hot, keys, "left").withColumns({"_r": _block_of(spread_left, n_rows), "_c": F.explode(_range(n_cols))})
    rhs = right.join(hot, keys, "left").withColumns({"_c": _block_of(spread_right, n_cols), "_r": F.explode(_range(n_rows))})
    joined = lhs.drop("_rows", "_cols").join(rhs.drop("_rows", "_cols"), [*keys, "_r", "_c"])
    return joined.drop("_r", "_c")


def pairs_within(df: DataFrame, keys: list[str], spread: str, condition: Column) -> DataFrame:
    """Each unordered pair of rows with equal keys for which `condition` holds, once: columns of `df`
    with `_a` and `_b`, keys as they are.

    `condition` is over those columns and must not depend on which row is a; rows are told apart by
    `spread`, which must be unique within a key. A key with n rows becomes a triangle of cells of
    ROWS_PER_BLOCK x ROWS_PER_BLOCK rows, so a pair of a key with any number of rows is compared
    exactly once and no task gets a whole key. Null keys match nothing.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = _materialised(sizes.where(F.col("_n") > ROWS_PER_BLOCK).select(*keys, _blocks(F.col("_n"), ROWS_PER_BLOCK).alias("_splits")))
    rest = [c for c in df.columns if c not in keys]
    sides = {s: [F.col(c).alias(f"{c}{s}") for c in rest] for s in ("_a", "_b")}
    ordered = F.col(f"{spread}_a") < F.col(f"{spread}_b")
    if hot is None:
        lhs, rhs = (df.select(*keys, *sides[s]) for s in ("_a", "_b"))
        return lhs.join(by_shuffle(rhs), keys).where(ordered & condition)
    one = F.coalesce("_splits", F.lit(1))
    placed = df.join(hot, keys, "left").withColumn("_block", _block_of(spread, one)).withColumn("_splits", one)
    lhs = placed.withColumn("_j", F.explode(F.sequence(F.col("_block"), F.col("_splits") - 1))).select(*keys, F.col("_block").alias("_i"), "_j", *sides["_a"])
    rhs = placed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_block")))).select(*keys, "_i", F.col("_block").alias("_j"), *sides["_b"])
    once = ordered | (F.col("_i") != F.col("_j"))
    return lhs.join(by_shuffle(rhs), [*keys, "_i", "_j"]).where(once & condition).drop("_i", "_j")
