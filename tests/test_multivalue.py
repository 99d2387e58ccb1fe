import pytest

from provgraph.operators.multivalue import explode_values
from tests.conftest import rows

CASES = {
    "A|B;C,D\tE": ["A", "B", "C", "D", "E"],
    "A / B + C": ["A", "B", "C"],
    "A/B + C-D": ["A/B", "C-D"],
    "A+B": ["A+B"],
    "A+": ["A"],
    "/ A": ["A"],
    "|A||B;": ["A", "B"],
    '"X, Y"|Z': ["X, Y", "Z"],
    "'X; Y',Z": ["X; Y", "Z"],
    '"G ""A"" S";B': ['G "A" S', "B"],
    '["P", "Q \\"r\\" s", "T, U"]': ["P", 'Q "r" s', "T, U"],
    "O'Neil|Rock'n'Roll": ["O'Neil", "Rock'n'Roll"],
    'open "quote|B': ['open "quote', "B"],
    'A\t"B|C"\tD': ["A", "B|C", "D"],
    '"A"/"B"': ["A", "B"],
    "a  b | c d": ["a b", "c d"],
    "0|\"x\"|": ["0", "x", ""],
    '""|A': ["A"],
    "": [],
    " | ; ": [],
    "[]": [],
    "Same|Same": ["Same", "Same"],
}


def test_cases(spark):
    df = spark.createDataFrame([(i, c, "clash") for i, c in enumerate(CASES)] + [(99, None, "clash")], "i int, v string, pos string")
    got: dict = {}
    for i, pos, value in rows(explode_values(df, "v", ["i"])):
        got.setdefault(i, []).append((pos, value))
    for i, (text, want) in enumerate(CASES.items()):
        assert [v for _, v in sorted(got.get(i, []))] == want, text
        assert [p for p, _ in sorted(got.get(i, []))] == list(range(len(want)))
    assert 99 not in got


@pytest.mark.parametrize("text", ["x" * 1_000_000, "a|" * 50_000, '"' + "b|" * 100_000 + '"', '"c",' * 20_000])
def test_very_long(spark, text):
    df = spark.createDataFrame([(1, text)], "i int, v string")
    want = 1 if text[0] in 'x"' and text[:3] != '"c"' else text.count("|") or text.count(",")
    assert explode_values(df, "v", ["i"]).count() == want


def test_empty(spark):
    assert rows(explode_values(spark.createDataFrame([], "i int, v string"), "v", ["i"])) == []
