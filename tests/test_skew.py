import itertools

import pytest
from pyspark.sql import functions as F

from provgraph.functions import skew
from tests.conftest import rows


def test_no_hot_keys_gives_plain_join(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert skew.hot_keys(df, ["k"]) is None


def test_salted_join_equals_join(spark, salting):
    left = spark.createDataFrame([(i % 5 if i % 3 else 0, i) for i in range(60)] + [(None, 99)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(4)], "k int, w string")
    hot = skew.hot_keys(left.where("k is not null"), ["k"])
    assert hot.count() == 5
    for how in ("inner", "left"):
        assert rows(skew.salted_join(left, right, ["k"], "v", hot, how)) == rows(left.join(right, "k", how))


def test_every_hot_key_is_split_by_its_own_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "_DRIVER_KEYS", 3)
    df = spark.createDataFrame([(i, 100_000 * i) for i in range(10)], "k int, n int")
    assert rows(skew.hot_keys(df, ["k"], "n")) == [(i, i) for i in range(2, 10)]
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 2)  # too many to broadcast: joined by shuffle, split all the same
    assert rows(skew.hot_keys(df, ["k"], "n")) == [(i, i) for i in range(2, 10)]


DATA = [(k, i) for k, n in ((1, 9), (2, 1), (3, 4)) for i in range(n)] + [(None, 1), (None, 2)]


@pytest.mark.parametrize("hot", [True, False])
def test_pairs_within_a_key_come_once(spark, request, hot):
    if hot:
        request.getfixturevalue("salting")
    df = spark.createDataFrame(DATA, "k int, v int")
    want = sorted((k, *p) for k in (1, 2, 3) for p in itertools.combinations([v for q, v in DATA if q == k], 2) if sum(p) != 5)
    got = skew.pairs_within(df, ["k"], "v", F.col("v_a") + F.col("v_b") != 5)
    assert rows(got.select("k", F.least("v_a", "v_b").alias("a"), F.greatest("v_a", "v_b").alias("b"))) == want


@pytest.mark.parametrize("hot", [True, False])
def test_grid_join_equals_join(spark, request, hot):
    if hot:
        request.getfixturevalue("salting")
    left = spark.createDataFrame(DATA, "k int, v int")
    right = spark.createDataFrame([(k, f"{k}{i}") for k, n in ((1, 7), (3, 1), (4, 2)) for i in range(n)] + [(None, "n")], "k int, w string")
    assert rows(skew.grid_join(left, right, ["k"], "v", "w")) == rows(left.join(right, "k"))


def test_no_task_gets_a_whole_hot_key(spark, monkeypatch):
    """50,000 rows of one key: no cell of the triangle holds more than a block from each side."""
    monkeypatch.setattr(skew, "ROWS_PER_BLOCK", 5_000)
    df = spark.range(50_000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    got = skew.pairs_within(df, ["k"], "v", F.abs(F.col("v_a") - F.col("v_b")) == 25_000)
    assert got.count() == 25_000
