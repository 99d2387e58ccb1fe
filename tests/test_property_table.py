import datetime as dt

import pytest

from provgraph import runtime
from provgraph.operators import property_table as T
from tests.conftest import day, rows

PROPS = "prop_row_id long, object_id string, property_name string, ordinal int, value string, confidence decimal(4,3), source_system string, extracted_at timestamp, verified_by string, num string"
CATALOG = [("P", "unitCost", "NUMBER", False), ("P", "isNew", "BOOLEAN", False), ("P", "at", "TIMESTAMP", False), ("P", "name", "STRING", False), ("P", "tags", "STRING", True)]


def typed(spark, values, objects=(("o1", "P"),)):
    props = [(i, o, p, n, v, None, "S", day(0), None, "clash") for i, (o, p, n, v) in enumerate(values)]
    return T.typed_properties(
        spark.createDataFrame(props, PROPS),
        spark.createDataFrame(list(objects), "id string, object_type string"),
        spark.createDataFrame(CATALOG, "object_type string, property_name string, value_type string, is_multiple boolean"),
    )


def states(spark, name, values):
    got = {r.prop_row_id: r.state for r in typed(spark, [("O1 ", name, 0, v) for v in values]).collect()}
    return [got[i] for i in range(len(values))]


def test_numbers(spark):
    ok = ["1", "-2.5e3", '"7"', '" +8. "', '".5"']
    bad = ["01", "+1", ".5", "1.", "true", '"1,5"', '"NaN"', "[1]", '{"v":1}', '"5', "x", ""]
    empty = [None, "null", ' null ', '""', '" \\t "']
    assert states(spark, "unit_cost", ok + bad + empty) == ["ok"] * 5 + ["unreadable"] * 12 + ["empty"] * 5


def test_booleans_and_strings(spark):
    assert states(spark, "IS NEW", ["true", '" False"', "1", '"yes"', "false"]) == ["ok", "ok", "unreadable", "unreadable", "ok"]
    assert states(spark, "Name", ['"x"', "1", "true", "[]", "<a>"]) == ["ok", "ok", "ok", "unreadable", "unreadable"]


def test_timestamps(spark):
    ok = ['"2024-02-29T00:00:00Z"', '" 2025-01-02T03:04:05.678+02:00"', '"2025-01-02T03:04-0530"', '"20250102T030405Z"']
    bad = ['"2025-02-29T00:00:00Z"', '"2025-01-02"', '"2025-01-02 03:04Z"', '"2025-01-02T03:04"', '"2025-13-01T00:00:00Z"', '"2025-01-02T24:10:00Z"', "20250102", "false"]
    assert states(spark, "at", ok + bad) == ["ok"] * 4 + ["unreadable"] * 8
    got = typed(spark, [("o1", "at", 0, ok[1])]).collect()[0]
    assert got.at == dt.datetime(2025, 1, 2, 1, 4, 5, 678000)


def test_undeclared_and_unknown_do_not_come_out(spark, salting):
    assert typed(spark, [("o1", "color", 0, "x"), ("o2", "name", 0, "x"), (None, "name", 0, "x"), ("o1", None, 0, "x")]).count() == 0


def test_wide(spark):
    values = [("o1", "name", 0, '"b"'), ("o1", "name", 0, '"a"'), ("o1", "tags", 1, '"y"'), ("o1", "tags", 0, '"x"'), ("o1", "tags", None, '"z"'), ("o1", "unitCost", 0, "1.5"), ("o2", "isNew", 0, "true"), ("o1", "unitCost", 0, "bad")]
    objects = spark.createDataFrame([("O1", "P"), ("o2", "P"), ("o3", "P"), ("o3", "P"), (None, "P")], "id string, object_type string")
    t = typed(spark, values, [("o1", "P"), ("o2", "P")])
    got = rows(T.wide_table(t, objects, [(n, t, m) for _, n, t, m in CATALOG]).select("object_id", "name", "tags", "unitCost", "isNew"))
    # Nulls sort first in Spark's struct order; equal rows are told apart by prop_row_id.
    assert got[0][:2] == ("o1", "b") and sorted(got[0][2]) == ["x", "y", "z"] and [v for v in got[0][2] if v != "z"] == ["x", "y"]
    assert got[0][3] == 1.5 and got[1] == ("o2", None, None, None, True) and got[2] == ("o3", None, None, None, None)


def test_empty(spark):
    t = typed(spark, [], [])
    assert t.count() == 0
    assert T.wide_table(t, spark.createDataFrame([], "id string"), [("name", "STRING", False)]).count() == 0


def test_every_value_of_a_list_without_ordinal_stays_and_is_last(spark):
    values = [("o1", "tags", None, '"n1"'), ("o1", "tags", 1, '"y"'), ("o1", "tags", None, '"n2"'), ("o1", "tags", 0, '"x"'), ("o1", "tags", None, '"n1"')]
    got = T.wide_table(typed(spark, values), spark.createDataFrame([("o1",)], "id string"), [("tags", "STRING", True)]).collect()
    assert [r.tags for r in got] == [["x", "y", "n1", "n2", "n1"]]


def test_conflicting_declarations_are_refused(spark):
    catalog = spark.createDataFrame([("A", "x", "STRING", False), ("B", "x", "string", False), ("A", "y", "NUMBER", True)], "object_type string, property_name string, value_type string, is_multiple boolean")
    assert T.catalog_columns(catalog) == [("x", "STRING", False), ("y", "NUMBER", True)]
    for kind, multiple in (("NUMBER", False), ("STRING", True)):
        other = spark.createDataFrame([("C", "x", kind, multiple)], catalog.schema)
        with pytest.raises(ValueError, match="x"):
            T.catalog_columns(catalog.unionByName(other))


def test_joins_of_the_wide_table_need_no_exchange_and_no_sort(spark):
    names = [(f"p{i}", "STRING", i % 3 == 0) for i in range(13)]
    typed = spark.range(200).selectExpr(
        "id AS prop_row_id", "concat('o', id % 20) AS object_id", "concat('p', id % 13) AS property", "CAST(id % 4 AS INT) AS ordinal", "CAST(1 AS DECIMAL(4,3)) AS confidence",
        "TIMESTAMP '2025-01-01' AS extracted_at", "string(id) AS text", "CAST(NULL AS DOUBLE) AS num", "CAST(NULL AS BOOLEAN) AS flag", "CAST(NULL AS TIMESTAMP) AS at", "'ok' AS state",
    )
    objects = spark.range(25).selectExpr("concat('o', id) AS id")
    wide = T.wide_table(typed, objects, names)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 13 + 2 and "Sort [" not in plan
    got = {r.object_id: r for r in wide.collect()}
    want = {}
    for i in range(200):
        want.setdefault((f"o{i % 20}", f"p{i % 13}"), []).append((i % 4, i))
    for (o, p), values in want.items():
        if names[int(p[1:])][2]:
            first = {k: min(i for q, i in values if q == k) for k, _ in values}
            assert got[o][p] == [str(first[k]) for k in sorted(first)]
        else:
            assert got[o][p] == str(min(values)[1])
    assert len(got) == 25 and all(v is None for v in list(got["o24"])[1:])
    runtime.release(spark)
    assert T.wide_table(typed, objects, names).count() == 25
