"""Frames as large as the input never pass through the driver, however small they are estimated."""

from pyspark.sql import functions as F

from provgraph.functions import skew
from provgraph.llm.names import name_links
from provgraph.runtime import cut


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin")


def test_no_large_join_is_a_broadcast(spark):
    # A list in one row is estimated as one element, also after a checkpoint.
    df = cut(spark.range(3).select("id", F.sequence(F.lit(1), F.lit(1000)).alias("ks"))).select("id", F.explode("ks").alias("k"))
    assert joins(skew.pairs_within(df, ["k"], "id", F.lit(True))) == (1, 0)
    assert joins(skew.salted_join(df, df.withColumnRenamed("id", "other"), ["k"], "id", None, large=True)) == (1, 0)


def test_large_joins_keep_their_hint_with_hot_keys(spark, salting):
    df = spark.createDataFrame([(k, v) for k in range(2) for v in range(5)], "k int, v int")
    sorted_joins, _ = joins(skew.salted_join(df, df.withColumnRenamed("v", "w"), ["k"], "v", skew.hot_keys(df, ["k"]), large=True))
    assert sorted_joins == 1  # the small table of split keys is broadcast on both sides
    assert joins(skew.pairs_within(df, ["k"], "v", F.lit(True)))[0] == 1


def test_too_many_split_keys_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "_DRIVER_KEYS", 1)
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 2)
    df = spark.createDataFrame([(k, 1) for k in range(5)], "k int, v int")
    hot = skew.hot_keys(df.withColumn("n", F.lit(skew.HOT_ROWS + 1)), ["k"], "n")
    assert hot.count() == 5 and joins(df.join(hot, "k", "left")) == (1, 0)


def test_candidates_of_names_are_joined_by_shuffle(spark):
    names = spark.createDataFrame([("Dafesal Gelezan",), ("Dafesal Gelezam",), ("Fofo Diwapar",)], "name string")
    _, links = name_links(names)
    assert joins(links)[1] == 0
    assert [(r.a.split("|")[3], r.b.split("|")[3]) for r in links.collect()] in ([("dafesal gelezan", "dafesal gelezam")], [("dafesal gelezam", "dafesal gelezan")])
