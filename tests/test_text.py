from pyspark.sql import functions as F

from provgraph.functions import text


def col(spark, values, f):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_squeeze_takes_any_whitespace(spark):
    assert col(spark, [" a\t\n b  ", "  　", "", None], text.squeeze) == ["a b", "", "", None]


def test_keys(spark):
    assert col(spark, ["  00Ab 1 ", "000", "\t", None], text.number_key) == ["ab 1", "0", None, None]
    assert col(spark, [" unit_Cost", "UNIT COST", "Größe-2"], text.name_key) == ["unitcost", "unitcost", "größe2"]


def test_numbers(spark):
    good = {"1": 1.0, " +2.5 ": 2.5, ".5": 0.5, "5.": 5.0, "-1e-2": -0.01}
    assert col(spark, list(good), text.to_number) == list(good.values())
    assert col(spark, ["NaN", "Infinity", "1d", "1,5", "", "٣", "8０", None], text.to_number) == [None] * 8
