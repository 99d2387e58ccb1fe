from decimal import Decimal

from provgraph.llm.survivors import surviving_rows
from tests.conftest import day, rows

PROPS = "prop_row_id long, object_id string, property_name string, ordinal int, value string, confidence decimal(4,3), source_system string, extracted_at timestamp, verified_by string, group_id string"


def run(spark, props, groups=()):
    def dec(x):
        return None if x is None else Decimal(x)

    data = [(i, o, p, 0, v, dec(c), s, t, by, "clash") for i, o, p, v, c, s, t, by in props]
    return rows(
        surviving_rows(
            spark.createDataFrame(data, PROPS),
            spark.createDataFrame([("o1", "P"), ("O2 ", "P"), ("o2", "P"), ("o3", "P")], "id string, object_type string"),
            spark.createDataFrame(list(groups), "id string, group_id string"),
            spark.createDataFrame([("P", "name", "STRING", False), ("P", "unitCost", "NUMBER", False), ("P", "tags", "STRING", True)], "object_type string, property_name string, value_type string, is_multiple boolean"),
            spark.createDataFrame([("SAP_A", 2), ("QMS", 1)], "source_system string, trust_rank int"),
        )
    )


def best(spark, *variants):
    """The surviving one of rows that differ as given: (confidence, source, time, verified)."""
    return run(spark, [(i, "o1", "name", f'"v{i}"', *v) for i, v in enumerate(variants)])[0][2]


def test_order_of_criteria(spark):
    assert best(spark, ("1.0", "QMS", day(9), None), ("0.1", None, None, "u")) == 1
    assert best(spark, ("0.9", "QMS", day(9), " "), ("0.95", None, None, None), (None, "QMS", day(99), None)) == 1
    assert best(spark, ("0.9", "QMS", day(1), None), ("0.9", None, day(2), None)) == 1
    assert best(spark, ("0.9", "sap a ", day(1), None), ("0.9", "qms", day(1), None), ("0.9", "other", day(1), None)) == 1
    assert best(spark, ("0.9", "QMS", None, None), ("0.9", "QMS", None, None)) == 0


def test_usable_rows_and_cases(spark):
    one = ("0.5", "QMS", day(0), None)
    bad = ["null", None, '"  "', '"N/A"', '"tbd"', "[1]", '"x', '" Not  known "']
    assert run(spark, [(i, "o1", "name", v, *one) for i, v in enumerate(bad)] + [(50, "o1", "name", '"a"', *one)]) == []
    assert run(spark, [(1, "o1", "unit cost", "1", *one), (2, "o1", "UNIT_COST", '"2"', *one), (3, "o1", "unitCost", '"n/a"', *one)]) == [("o1", "unitCost", 1)]
    assert run(spark, [(1, "o1", "tags", '"a"', *one), (2, "o1", "tags", '"b"', *one)]) == []


def test_groups_count_together(spark, salting):
    one = ("0.5", "QMS", day(0), None)
    props = [(1, "o1", "name", '"a"', *one), (2, "O2", "name", '"b"', "0.7", "QMS", day(0), None), (3, "o3", "name", '"c"', *one)]
    assert run(spark, props, [("o1", "o1"), ("o2", "o1")]) == [("o1", "name", 2)]


def test_empty(spark):
    assert run(spark, []) == []
