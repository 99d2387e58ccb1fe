import itertools

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from provgraph.llm import packing as P


def optimum(sizes, capacity):
    """Least number of containers by trying everything."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best and i < len(sizes):
            return
        if i == len(sizes):
            best = min(best, len(bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        place(i + 1, bins + [sizes[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=7))
def test_bound_and_packing_enclose_the_optimum(sizes):
    a = np.array(sizes, dtype=np.int64)
    where = P.best_fit_decreasing(a, 20)
    assert all(load <= 20 for load in np.bincount(where, weights=a)) if sizes else True
    used = len(set(where.tolist()))
    best = optimum(sorted(sizes, reverse=True), 20)
    assert P.lower_bound(a, 20) <= best <= used
    values, counts = np.unique(a, return_counts=True)
    assert P.lower_bound(values, 20, counts) == P.lower_bound(a, 20)


def test_bound_sees_items_above_half():
    assert P.lower_bound(np.array([11, 11, 11, 9]), 20) == 3
    assert P.lower_bound(np.array([], dtype=np.int64), 20) == 0


def run(spark, sizes, budgets=((1, 10), (2, 25))):
    df = spark.createDataFrame([(i, n, "clash") for i, n in enumerate(sizes)], "doc_id long, n_tokens long, bin string")
    return P.pack(df, spark.createDataFrame(list(budgets), "budget_id int, capacity_tokens int")).toPandas()


def whole(out, sizes, budgets=((1, 10), (2, 25))):
    for b, capacity in budgets:
        mine = out[out.budget_id == b]
        assert mine.groupby("container").n_tokens.sum().max() <= capacity if len(mine) else True
        for i, n in enumerate(sizes):
            pieces = mine[mine.doc_id == i].sort_values("piece")
            assert pieces.n_tokens.sum() == n and len(pieces) == max(1, -(-n // capacity))
            assert list(pieces.first_token) == [k * capacity for k in range(len(pieces))]


def test_every_document_once_and_no_needless_split(spark):
    sizes = [0, 0, 3, 10, 11, 25, 26, 60, 7, 7, 4, 9, 1]
    whole(run(spark, sizes), sizes)


def test_rounds_exchange_documents(spark, monkeypatch):
    monkeypatch.setattr(P, "PARTITION_ITEMS", 24)
    sizes = np.random.default_rng(3).integers(20, 45, 300).tolist()
    out = run(spark, sizes, ((2, 100),))
    whole(out, sizes, ((2, 100),))
    assert out.container.str.startswith("2-r1").any()
    assert out.container.nunique() <= 1.15 * P.lower_bound(np.array(sizes), 100)


def test_same_rows_same_containers(spark):
    sizes = list(range(1, 24)) * 2
    a, b = (run(spark, sizes).sort_values(["budget_id", "doc_id", "piece"], ignore_index=True) for _ in range(2))
    pd.testing.assert_frame_equal(a, b)


def test_empty(spark):
    assert len(run(spark, [])) == 0
    assert len(run(spark, [5], ((1, 0),))) == 0


def test_report_meets_the_packing(spark):
    sizes = [3, 10, 11, 25, 26, 7]
    budgets = spark.createDataFrame([(1, 10), (2, 25)], "budget_id int, capacity_tokens int")
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    for r in P.packing_report(P.pack(df, budgets), budgets).collect():
        assert r.lower_bound <= r.n_containers and r.n_docs == 6 and r.n_tokens == sum(sizes)


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "word " * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in P.token_counts(docs, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 50_000
    assert list(itertools.islice(got, 0)) == []
