import pytest

from provgraph.llm import lookalike as L
from tests.conftest import rows


@pytest.fixture(scope="module")
def plain(spark):
    return L.Rewriter(L.classes(L.look_alike_pairs(spark), {}))


SAME = [
    ("Hello", "Ｈеllо"), ("file", "ﬁle"), ("a b", "a b"), ("a b", "a b"), ("a b", "a\tb"), ("word", "w​o­rd﻿"),
    ("é", "é"), ("co-op", "co‐op"), ("co-op", "co‑op"), ("Room 101", "Ｒoom １０１"), ("I", "Ι"), ("l", "ⅼ"), ("O", "О"), ("ǖ", "ǖ"),
    ("ἀ", "ἀ"), ("offer", "oﬀer"), ("ABC", "𝐀𝐁𝐂"),
    ("c", "ϲ"), ("C", "Ϲ"),
]
DIFFERENT = [("e", "é"), ("o", "ö"), ("l", "1"), ("O", "0"), ("I", "l"), ("rn", "m"), ("a b", "ab"), ("a b", "a\nb"), ("x2", "x²"), ("a", "A"), ("й", "и"), ("", " ")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(plain, a, b):
    assert plain(a) == plain(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(plain, a, b):
    assert plain(a) != plain(b)


def test_plain_form_is_stable_and_ascii_is_kept(plain):
    for a, b in SAME + DIFFERENT:
        for t in (a, b):
            assert plain(plain(t)) == plain(t)
            if t.isascii():
                assert plain(t) == t.replace("\t", " ")


def test_classes_are_transitive_and_by_frequency():
    table = L.classes([("α", "ɑ"), ("ɑ", "⍺"), ("xy", "ж"), ("ж", "xz")], {"⍺": 9, "α": 3})
    assert table["α"] == table["ɑ"] == "⍺" and "⍺" not in table
    assert table["ж"] == "xy" and "xz" not in table


def test_very_long(plain):
    for t in ("a" * 1_000_000 + "é", "é" * 300_000, "а" * 300_000, ("x" * 50 + "а ") * 5000):
        assert plain(plain(t)) == plain(t)


def test_pairs(spark, salting):
    texts = ["Same text", "Ѕame text", "Sаme​ text", "Same text", "sàme text", "same text", None, "", "​", "", "other"]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, plain binary")
    got = rows(L.same_looking_pairs(docs, "doc_id", "text"))
    assert got == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (7, 8), (8, 9)]


@pytest.mark.parametrize("hot", [True, False])
def test_classes_and_copies(spark, request, hot):
    if hot:
        request.getfixturevalue("salting")
    texts = ["Same text"] * 4 + ["Ѕame text"] * 3 + ["Sаme text", "lone", "lone"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    assert rows(L.same_looking_classes(docs, "doc_id", "text")) == [(i, 0 if i < 4 else 4 if i < 7 else 7, 0) for i in range(8)]
    want = [(a, b) for a in range(8) for b in range(a + 1, 8) if texts[a] != texts[b]]
    assert rows(L.same_looking_pairs(docs, "doc_id", "text")) == want


def test_one_variant_of_many_copies(spark):
    """50,000 byte-equal copies and one disguised one: 50,000 pairs, and copies aren't compared with each other."""
    many = spark.range(50_000).selectExpr("id AS doc_id", "'Same text' AS text")
    docs = many.unionByName(spark.createDataFrame([(50_000, "Ѕame text")], "doc_id long, text string"))
    got = L.same_looking_pairs(docs, "doc_id", "text")
    assert got.count() == 50_000 and got.where("doc_id_b <> 50000").isEmpty()


def test_representatives_settle():
    chain = {chr(0x3B1 + i): chr(0x3B1 + i + 1) for i in range(8)}
    assert L._settled("α", chain) == "ι"
    assert L._settled("α", {"α": "β", "β": "α"}) == "α"


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rows(L.same_looking_pairs(docs, "doc_id", "text")) == []
    assert L.corpus_frequency(docs, "text") == {}


def test_plain_texts_and_frequencies(spark):
    docs = spark.createDataFrame([(1, "Ｈi"), (2, None), (3, "éé Ｈ")], "doc_id long, text string")
    assert L.corpus_frequency(docs, "text") == {"Ｈ": 2, "é": 2}
    assert rows(L.plain_texts(docs, "doc_id", "text", L.plain_form_rewriter(docs, "text"))) == [(1, "Hi"), (2, None), (3, "éé H")]
