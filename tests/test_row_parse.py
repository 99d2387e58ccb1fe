import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from provgraph.operators import row_parse as P
from tests.conftest import rows

SCHEMA = [P.alnum_field("K", "bad_k"), P.RowField("T", nullable=True), P.enum_field("E", "bad_e", ["ONE", "TWO"]), P.number_field("N", "bad_n", not_negative=True)]


def parse(line):
    """RFC 4180 by hand: the fields, or None for broken quoting."""
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                q = line.find('"', j)
                if q < 0:
                    return None
                text += line[j:q]
                if line[q + 1 : q + 2] == '"':
                    text, j = text + '"', q + 2
                    continue
                i = q + 1
                break
            if i < len(line) and line[i] != ",":
                return None
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            text = line[i:j]
            if '"' in text:
                return None
            i = j
        fields.append(text)
        if i >= len(line):
            return fields
        i += 1


def brute(line):
    f = parse(line or "")
    if f is None:
        return ["quoting"]
    if len(f) != 4:
        return ["column_count"]
    try:
        n = float(f[3]) if not set(f[3].lower()) & set("nit_") else -1.0
    except ValueError:
        n = -1.0
    out = [] if any(c.isalnum() for c in f[0]) else ["bad_k"]
    out += [] if f[2].strip().upper() in ("ONE", "TWO") else ["bad_e"]
    return out + ([] if n >= 0 else ["bad_n"])


def reasons(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, raw string")
    return {r.i: list(r._reasons) for r in P.parse_rows(df, "raw", SCHEMA).collect()}


CASES = [
    "a,b,ONE,1", '"a","b""c,d",two ," 1.5 "', 'a,b"c,ONE,1', '"a"x,b,ONE,1', '"a,b,ONE,1', "a,b,ONE", "a,b,ONE,1,", "--,,x,-1",
    "a,,ONE,-0.0", "a,,ONE,1e3", "a,,ONE,", "", None, 'a,"x\ny",ONE,.5', '"",,ONE,1', '"""",b,ONE,5.', "é,b, one ,+1",
]


def test_cases(spark):
    got = reasons(spark, CASES)
    assert {i: got[i] for i in got} == {i: brute(c) for i, c in enumerate(CASES)}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='ab,"1. ONE-\n', max_size=16), min_size=40, max_size=80))
def test_random_lines(spark, lines):
    got = reasons(spark, lines)
    assert [got[i] for i in range(len(lines))] == [brute(x) for x in lines]


def test_first_broken_field(spark):
    df = spark.createDataFrame([(1, "a,b,NO,x"), (2, 'a,b"b,ONE,1'), (3, "a,b"), (4, "a,b,ONE,1,2"), (5, "a,b,ONE,1")], "i int, raw string")
    got = {r.i: r._broken_field for r in P.parse_rows(df, "raw", SCHEMA).collect()}
    assert got == {1: 3, 2: 2, 3: 3, 4: 5, 5: None}


def test_loaded_and_rejects_share_out_all_rows(spark):
    df = spark.createDataFrame([(i, c, "x") for i, c in enumerate(CASES)], "i int, raw string, reason string")
    parsed = P.parse_rows(df, "raw", SCHEMA)
    good = rows(P.loaded(parsed, "raw", SCHEMA, ["i"]))
    assert good[1] == (1, "a", 'b"c,d', "two ", " 1.5 ")
    bad = {r[0] for r in rows(P.rejects(parsed, ["i"]))}
    assert {r[0] for r in good} | bad == set(range(len(CASES))) and not {r[0] for r in good} & bad


@pytest.mark.parametrize("line", ['"' + '""' * 200_000 + '",b,ONE,1', "a" * 1_000_000 + ",b,ONE,1", ",".join("a" * 50_000), '"' * 99_999])
def test_very_long_rows(spark, line):
    assert reasons(spark, [line])[0] == brute(line)


def test_empty_table(spark):
    df = spark.createDataFrame([], "i int, raw string")
    assert rows(P.rejects(P.parse_rows(df, "raw", SCHEMA), ["i"])) == []
