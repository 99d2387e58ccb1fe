import itertools
import random

import pytest

from provgraph.llm import names as N
from provgraph.llm.names import Vocabulary, edits, given_fits, likeness, same_entities, split_name
from tests.conftest import rows

VOCABULARY = Vocabulary({"electronics": True, "technologies": True, "michal": False}, {"elec": "electronics"}, {"thomas": ["tom"]})


def parse_name(name):
    return N.parse_name(*split_name(name), VOCABULARY)


def test_parsing():
    assert parse_name("Dafesal Elec., Gelezan Ltd") == ("electronics", "", "", ["dafesal", "gelezan"], [])
    assert parse_name(" Fofo.\tDiwapar Technologies") == ("technologies", "", "", ["diwapar", "fofo"], ["fofo"])
    assert parse_name("Fofo Diwapar Techn.")[0] == parse_name("Fofo Diwapar Tecnologies")[0] == "technologies"
    assert parse_name("Piweber - Tehisol, Michael")[:4] == ("", "michal", "michal", ["piweber", "tehisol"])
    assert parse_name("Dr. T. Mifasi Mehiper")[:2] == ("", "t.") and parse_name("Tom Mifasi")[1] == "thomas"
    assert parse_name("Gopömer Penehan GmbH")[3] == parse_name("GOPOEMER PENEHAN G.m.b.H.")[3]
    assert split_name("Acme S. A.") == (["acme"], [], [], True)


@pytest.mark.parametrize("a,b,d", [("abcd", "abdc", 1), ("abc", "abc", 0), ("abc", "abxc", 1), ("abc", "xyz", 2), ("", "ab", 2), ("a" * 9, "b", 2)])
def test_edits(a, b, d):
    assert min(edits(a, b, 1), 2) == d


def test_given_names():
    assert [given_fits(*p) for p in (("michael", "michael"), ("m.", "michael"), ("t.", "michael"), ("", "michael"), ("robert", "rupert"))] == ["yes", "maybe", "no", "maybe", "no"]


def test_rare_tokens_count_more():
    args = (["common", "rarexyz"], ["common", "rarexab"], [], [])
    assert likeness(*args, [1.0, 9.0], [1.0, 9.0]) < likeness(*args, [9.0, 1.0], [9.0, 1.0])


def test_every_token_needs_a_counterpart():
    same = (["gelezan", "dafesal", "robotics"], ["gelezan", "dafesal", "aerospace"], [], [])
    assert likeness(*same, [9.0, 9.0, 0.1], [9.0, 9.0, 0.1]) == 0.0
    assert likeness(["gelezan", "dafesal"], ["gelezan", "dafesal", "robotics"], [], [], [1.0] * 2, [1.0] * 3) == 0.0


def _typo(word, rnd):
    k = rnd.randrange(1, len(word) - 1)
    return rnd.choice([word[:k] + word[k + 1 :], word[:k] + word[k] + word[k:], word[:k] + word[k + 1] + word[k] + word[k + 2 :], word[:k] + rnd.choice("aeioklmn") + word[k + 1 :]])


LINES = {"Robotics": ["Robot.", "Robotics"], "Aerospace": ["Aerosp.", "Aero."], "Bearings": ["Bear.", "Brgs"], "Foundry": ["Found.", "Fndry"]}
PERSONS = {"Giuseppe": ["Beppe"], "Rosalind": ["Roz"], "Ferdinand": ["Ferdi"], "Konstantin": ["Kostja"]}


def _suppliers(n, seed):
    """Suppliers of lines and given names that no list of the operator holds, each typed in three ways."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bdfghklmnprstvz") + rnd.choice("aeiou") for _ in range(3)).capitalize() + rnd.choice("lnrs")
    out = []
    for k in range(n):
        a, b = word(), word()
        if k % 5 == 0:
            given = rnd.choice(list(PERSONS))
            typed = lambda g=given, a=a, b=b: rnd.choice([f"{g} {a}-{b}", f"{a} {b}, {g}", f"{PERSONS[g][0]} {a} {b}", f"{g} {_typo(a.lower(), rnd)} {b}", f"Dr. {g} {a} - {b}"])
            out.append([typed() for _ in range(3)] + [f"{given} {a} {b}"])
            continue
        line = rnd.choice(list(LINES))
        typed = lambda n=line, a=a, b=b: rnd.choice([
            f"{a} {b} {n} Ltd", f"{b} {n}, {a} Limited", f"{a} {_typo(b.lower(), rnd)} {n}", f"{a}{b.lower()} {n} Ltd.", f"{a} {b} {rnd.choice(LINES[n])} Ltd",
            f"{n} {a} {b}", f"{a[:4]}. {b} {n} Ltd", f"{a.upper()} {b.upper()} {n.upper()}",
        ])
        out.append([typed() for _ in range(3)] + [f"{a} {b} {line}"])
        if k % 3 == 0:  # another supplier of the same name in another line
            out.append([f"{a} {b} {rnd.choice([x for x in LINES if x != line])} Ltd"])
    return out


@pytest.mark.parametrize("n", [14, 400])
def test_lines_and_given_names_beyond_any_list(spark, n):
    data, want, at = [], set(), 1000
    for names in _suppliers(n, 5):
        ids = [str(at + i) for i in range(len(names))]
        at += len(names)
        data += list(zip(ids, names, strict=True))
        want |= set(itertools.combinations(ids, 2))
    got = set(rows(same_entities(spark.createDataFrame(data, "n string, v string"), "n", "v")))
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.97 * len(got)


def test_vocabulary_is_learned(spark):
    names = [v for names in _suppliers(400, 7) for v in names]
    split = spark.createDataFrame([(v, *split_name(v)) for v in names], N._SPLIT)
    found = N.learned_vocabulary(split, {})
    assert {w for w, is_line in found.common.items() if is_line} >= {N.fold(w) for w in ("robotics", "aerospace", "bearings", "foundry")}
    assert found.aliases["brgs"] == "bearings" and found.aliases["fndry"] == "foundry"
    assert not N.learned_vocabulary(split.limit(0), {}).common


GROUPS = [
    ["Gelezan Dafesal Electronics Limited", "Gelezan Dafrsal Elec. Ltd.", "Dafesal Electronics, Gelezan", "GELEZANDAFESAL ELECTRONICS"],
    ["Gelezan Dafesal Packaging Ltd"],
    ["Susanne Sipezi-Haviper", "Sipezi-Haviper, Susi", "Ing. Susanne Sipezi Haviper"],
    ["Patricia Sipezi-Haviper", "Trish Sipezi - Haviper"],
    ["Thomas Mifasi-Mehiper", "T. Mifasi-Mehiper"],
    ["Kivari Lotahon Logistics Limited"],
]


def test_groups(spark):
    data, want, n = [], set(), 0
    for group in GROUPS:
        ids = [str(100 + n + i) for i in range(len(group))]
        n += len(group)
        data += [(f" 00{i} ", name, "clash") for i, name in zip(ids, group, strict=True)]
        want |= {tuple(sorted(p)) for p in itertools.combinations(ids, 2)}
    data += [("900", " \t ", "x"), ("901", None, "x"), (None, GROUPS[0][0], "x"), ("102", GROUPS[0][2], "again")]
    df = spark.createDataFrame(data, "LIFNR string, NAME1 string, sig string")
    assert set(rows(same_entities(df, "LIFNR", "NAME1"))) == want


def test_initial_of_two_persons_joins_neither(spark):
    data = [("1", "Thomas Mifasi-Mehiper"), ("2", "Theodor Mifasi-Mehiper"), ("3", "T. Mifasi-Mehiper")]
    assert rows(same_entities(spark.createDataFrame(data, "n string, v string"), "n", "v")) == []


def test_copies_empty_and_long(spark, salting):
    assert rows(same_entities(spark.createDataFrame([], "n string, v string"), "n", "v")) == []
    data = [(str(i), "Kivari Lotahon Logistics") for i in range(12)] + [("99", "x" * 200_000), ("98", "??"), ("97", "Co")]
    got = rows(same_entities(spark.createDataFrame(data, "n string, v string"), "n", "v"))
    assert len(got) == 12 * 11 // 2
