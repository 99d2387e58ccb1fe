import random

import numpy as np
import pytest

from provgraph.llm import leakage as K
from provgraph.llm.lookalike import Rewriter, classes, look_alike_pairs
from tests.conftest import rows

WORDS = [f"{a}{b}" for a in ("al", "bo", "cu", "de", "fi", "go", "hy") for b in ("ran", "lex", "tor", "min", "sup", "wen")]


@pytest.fixture(scope="module")
def rewriter(spark):
    return Rewriter(classes(look_alike_pairs(spark), {}))


def passage(seed, n=60):
    rnd = random.Random(seed)
    return [rnd.choice(WORDS) for _ in range(n)]


@pytest.mark.parametrize("raw,want", [
    ("The Cat,\nsat -- 9.5!", ["the", "cat", "sat", "95"]),
    (r"\emph{one} {\it two} \textbf{th}ree", ["one", "two", "three"]),
    ("con-\n% nected dis\\-crete", ["connected", "discrete"]),
    ("% a comment\n% goes on", ["a", "comment", "goes", "on"]),
    (r"Str\"omung gro{\ss}er \'{e}t\'e \c{c}a", ["stromung", "grosser", "ete", "ca"]),
    (r"x~y \cite[p.~3]{foo} z \label{eq:a}", ["x", "y", "z"]),
    (r"\newcommand{\abc}[0]{\mathrm{metric}} the \abc{} of \abc", ["the", "metric", "of", "metric"]),
    ("Ѕуstеm​s ofﬁce", ["systems", "office"]),
    ("", []),
])
def test_plain_words(rewriter, raw, want):
    assert K.plain_words(raw, rewriter) == want


def search(rewriter, items, least=22):
    return K.make_search(items, rewriter, K.make_lsh(least // 2, 1, 0.9, 6, 17), least)


def leaks(texts, s):
    """For each text the ids of the items it leaks."""
    found = [set() for _ in texts]
    for t, item, run, _ in K.leaks_of([K.coded(x, s.rewriter) for x in texts], s):
        if run >= s.least:
            found[t].add(item)
    return found


def longest(doc, item):
    return max((sum(1 for _ in _run(doc, item, i, j)) for i in range(len(doc)) for j in range(len(item))), default=0)


def _run(doc, item, i, j):
    while i < len(doc) and j < len(item) and doc[i] == item[j]:
        yield i
        i, j = i + 1, j + 1


def test_run_lengths_around_the_limit(rewriter):
    item = passage(1)
    s = search(rewriter, [(7, " ".join(item))])
    rnd = random.Random(2)
    for n in (10, 21, 22, 23, 40):
        for start in (0, 5, 20):
            for lead in range(0, 23, 3):
                before = ["zzz"] * lead + [rnd.choice(WORDS) + "x"]
                doc = before + item[start : start + n] + ["yyy"] + passage(9, 12)
                assert leaks([" ".join(doc)], s) == [{7} if longest(doc, item) >= 22 else set()]


def test_against_brute_force(rewriter):
    rnd = random.Random(4)
    items = [(i, passage(100 + i, 30 + i)) for i in range(6)]
    docs = []
    for _ in range(60):
        i, a, n = rnd.randrange(6), rnd.randrange(10), rnd.randrange(15, 30)
        docs.append(passage(rnd.random(), rnd.randrange(30)) + items[i][1][a : a + n] + passage(rnd.random(), rnd.randrange(30)))
    s = search(rewriter, [(i, " ".join(p)) for i, p in items])
    want = [{i for i, p in items if longest(d, p) >= 22} for d in docs]
    assert leaks([" ".join(d) for d in docs], s) == want and any(want)


def test_embedding_maps_equal_to_equal_and_near_to_near():
    rnd = np.random.default_rng(0)
    steps = rnd.integers(1, 2**63, 33, dtype=np.uint64)
    x, far = (rnd.integers(1, 2**62, (200, 11), dtype=np.uint64) for _ in range(2))
    e, f, g = (K.embed(v, steps) for v in (x, K.edited_windows(x, 1, rnd), far))
    assert (K.embed(x, steps) == e).all()
    assert (e != f).sum() < 0.7 * (e != g).sum()


@pytest.mark.parametrize("edits,target", [(1, 0.9), (1, 0.99), (2, 0.9)])
def test_recall_of_edited_windows_reaches_its_target(edits, target):
    """On pairs of windows that weren't used to find the number of repetitions."""
    lsh = K.make_lsh(11, edits, target, 6, 17)
    rnd = np.random.default_rng(3)
    x = rnd.integers(1, 2**62, (4_000, 11), dtype=np.uint64)
    met = (lsh.keys(x) == lsh.keys(K.edited_windows(x, edits, rnd))).any(axis=0).mean()
    assert met >= target - 0.02 and (lsh.keys(x) == lsh.keys(x.copy())).all()


def distance(a, b):
    last = list(range(len(a) + 1))
    for i, y in enumerate(b, 1):
        row = [i]
        for j, x in enumerate(a, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
        last = row
    return last


def test_window_distances_are_exact():
    rnd = np.random.default_rng(5)
    for most in (0, 1, 2):
        b = rnd.integers(1, 4, (300, 7), dtype=np.uint64)
        a = np.concatenate([K.edited_windows(b, most, rnd) % np.uint64(5), rnd.integers(1, 4, (300, most), dtype=np.uint64)], axis=1)
        want = [min(distance(x, y)[7 - most : 7 + most + 1]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        got = K.window_distances(a, b, most).tolist()
        assert [min(g, most + 1) for g in got] == [min(w, most + 1) for w in want] and 0 in want


@pytest.mark.parametrize("new_word", ["unseen", "known"])
def test_edited_passages_are_found(rewriter, new_word):
    """Whole passages with one word in 20 replaced: none need have 22 equal words in a row."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3_000)]
    items = [(i, [rnd.choice(vocabulary) for _ in range(60)]) for i in range(200)]
    s = search(rewriter, [(i, " ".join(p)) for i, p in items])
    texts = []
    for _, p in items:
        other = (lambda: rnd.choice(vocabulary)) if new_word == "known" else (lambda: f"new{rnd.randrange(10**9)}")
        q = [other() if k % 20 == 10 else w for k, w in enumerate(p)]
        texts.append(" ".join(rnd.choices(vocabulary, k=rnd.randrange(40)) + q + rnd.choices(vocabulary, k=30)))
    found = K.leaks_of([K.coded(t, rewriter) for t in texts], s)
    near = {(t, item) for t, item, run, near in found if near >= 22}
    assert len(near & {(i, i) for i in range(200)}) >= 0.95 * 200 and all(t == i for t, i in near)
    assert all(run < 22 for _, _, run, _ in found)


def test_alignment():
    a, b = list("abcdefghijklmnopqrstuvwxyz"), list("abcdefghijklXnopqrstuvwxyz")
    assert K.aligned_words(a, 0, b, 0, 1, 10) == 25 and K.aligned_words(a, 0, b, 0, 1, 100) == 13
    assert K.aligned_words(a[:12] + a[13:], 0, a, 0, 1, 10) == 25


def test_macros_nest_to_any_depth_and_end_in_circles(rewriter):
    chain = "".join(rf"\def\{a}{{\{b}}}" for a, b in zip("abcdefg", "bcdefgh", strict=True)) + r"\def\h{deep word}"
    assert K.plain_words(chain + r" x \a{} y", rewriter) == ["x", "deep", "word", "y"]
    assert K.plain_words(r"\def\a{one \b}\def\b{two \a} x \a y", rewriter)[:3] == ["x", "one", "two"]
    assert K.plain_words(r"\newcommand{\x}{{a {b {c {d}}}}} \x", rewriter) == ["a", "b", "c", "d"]
    doubling = "".join(rf"\def\m{chr(97 + i)}{{\m{chr(98 + i)}\m{chr(98 + i)}}}" for i in range(24)) + r"\def\my{z}"
    assert len(K.plain_words(doubling + r" \ma", rewriter)) < 1_000_000
    assert K.plain_words(r"\def\a{never closed \a", rewriter) == ["never", "closed"]


def test_documents_and_items_of_every_kind(spark, rewriter):
    item = " ".join(passage(1))
    docs = spark.createDataFrame(
        [(1, item, 0), (2, None, 0), (3, "", 0), (4, "zzz " * 100_000 + item.upper(), 0), (5, "% " + item.replace(" ", "~"), 0), (6, "\\" * 100_000, 0), (7, "\\cite{" * 30_000, 0), (8, "a-\n" * 50_000, 0)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([(10, item), (11, "too short"), (12, None), (13, ""), (10, " ".join(passage(2)))], "item_id long, passage string")
    got = rows(K.leaked_items(docs, "doc_id", "text", items, "item_id", "passage", rewriter))
    assert got == [(1, 10), (4, 10), (5, 10)]
    assert rows(K.leaked_items(docs, "doc_id", "text", items.where("false"), "item_id", "passage", rewriter)) == []
    assert rows(K.leaked_items(docs.where("false"), "doc_id", "text", items, "item_id", "passage", rewriter)) == []


def test_blocks_of_items(spark, rewriter, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ITEMS", 2)
    texts = [" ".join(passage(i)) for i in range(5)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, passage string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert rows(K.leaked_items(docs, "doc_id", "text", items, "item_id", "passage", rewriter)) == [(i, i) for i in range(5)]
