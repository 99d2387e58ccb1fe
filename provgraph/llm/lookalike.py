"""Visually identical text with different characters: one consistent form.

Look-alikes are strings and code points that show the same. A union-find over them gives transitive
classes; each class gets a representative, plain ASCII first and then by frequency in the corpus;
texts are rewritten greedily (longest match first, left to right) with a multi-pattern automaton.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.functions.skew import grid_join, hot_keys, pairs_within, salted_join
from provgraph.runtime import cut, ship

_CATEGORY_OF = {"Lu": "A", "Lt": "A", "Ll": "a", "Lm": "a", "Lo": "a", "Nd": "0", "Nl": "0", "No": "0"}


def _shape(ch: str) -> str:
    kind = unicodedata.category(ch)
    return _CATEGORY_OF.get(kind, kind[0])


def invisible(ch: str) -> bool:
    """Characters that show nothing: format characters, variation selectors, fillers."""
    cp = ord(ch)
    return (
        unicodedata.category(ch) == "Cf"
        or 0xFE00 <= cp <= 0xFE0F
        or 0xE0100 <= cp <= 0xE01EF
        or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
    )


def blank(ch: str) -> bool:
    """Characters that show a blank (line breaks are not blanks)."""
    return unicodedata.category(ch) == "Zs" or ch == "\t"


def look_alike_pairs(spark: SparkSession) -> list[tuple[str, str]]:
    """(string, string) pairs that show the same, for all assigned code points.

    The pairs come from rules, not from a table: Unicode compatibility decomposition for width,
    font and ligature forms, canonical decomposition, and the confusable skeletons of the ICU
    library that Spark ships. A skeleton may hold an ASCII character that stands for several
    (l for l, I, 1 and |); the one of the same kind of character is taken. ASCII characters are
    different from each other. The number of pairs is bounded by the size of Unicode.
    """
    points = [
        chr(cp) for cp in range(0x80, 0x110000)
        if unicodedata.category(chr(cp)) not in ("Cn", "Cs", "Co", "Cc") and not 0xAC00 <= cp <= 0xD7A3
    ]
    points = [ch for ch in points if not invisible(ch) and not blank(ch) and not unicodedata.combining(ch)]
    ascii_chars = [chr(c) for c in range(33, 127)]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    both = ascii_chars + points
    skeletons = checker.getSkeleton("\n".join(both)).split("\n")
    if len(skeletons) != len(both):
        skeletons = [checker.getSkeleton(ch) for ch in both]
    skeleton_of = dict(zip(both, skeletons, strict=True))
    plain: dict[str, list[str]] = {}
    for ch, skeleton in zip(ascii_chars, skeletons, strict=False):
        plain.setdefault(skeleton, []).append(ch)
    pairs: list[tuple[str, str]] = []
    for ch, skeleton in zip(points, skeletons[len(ascii_chars) :], strict=False):
        decomposed = unicodedata.normalize("NFKD", ch)
        # What is decomposed to another character than the one it looks like (a lunate sigma looks like
        # c, not like a final sigma) is taken for the latter.
        misled = decomposed != ch and len(decomposed) == 1 and not decomposed.isascii() and skeleton in plain and skeleton_of.get(decomposed) != skeleton
        if decomposed != ch and not misled and not any(blank(c) or invisible(c) for c in decomposed):
            canonical = unicodedata.normalize("NFD", ch)
            # Raised and lowered forms can be told apart from the plain ones.
            if canonical != ch or not re.match(r"<(super|sub|fraction|square|circle)>", unicodedata.decomposition(ch)):
                pairs.append((ch, decomposed))
            continue
        if skeleton == ch or not skeleton:
            continue
        if skeleton in plain:
            alike = [c for c in plain[skeleton] if _shape(c) == _shape(ch)] or [
                c for c in plain[skeleton] if _shape(c)[0] not in "Aa0"
            ]
            if alike:
                pairs.append((ch, skeleton if skeleton in alike else alike[0]))
        elif len(skeleton) == 1 and _shape(skeleton) == _shape(ch):
            pairs.append((ch, skeleton))
    return pairs


def classes(pairs: list[tuple[str, str]], frequency: dict[str, int]) -> dict[str, str]:
    """string -> representative of its look-alike class, both in canonical decomposition, for all
    strings but representatives.

    Union-find makes the relation transitive. The representative is, in this order: plain ASCII,
    the more frequent in the corpus, the shorter, the smaller. Two different ASCII strings are
    never in one class: a union that would join them is left out.
    """
    parent: dict[str, str] = {}
    ascii_of: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        for s in (a, b):
            if s.isascii():
                ascii_of[find(s)] = s
        x, y = find(a), find(b)
        p, q = ascii_of.get(x), ascii_of.get(y)
        if x == y or (p and q and p != q):
            continue
        parent[y] = x
        if p or q:
            ascii_of[x] = p or q
    members: dict[str, list[str]] = {}
    for s in parent:
        members.setdefault(find(s), []).append(s)
    table = {}
    for group in members.values():
        best = min(group, key=lambda s: (not s.isascii(), -frequency.get(s, 0), len(s), s))
        table.update({s: best for s in group if s != best})
    decomposed = {}
    for s, rep in table.items():
        rep = _settled(rep, table)
        # Texts are decomposed before they are rewritten, so only decomposed strings are met.
        s, rep = unicodedata.normalize("NFD", s), unicodedata.normalize("NFD", rep)
        if s != rep and not any(c.isspace() for c in s):
            decomposed[s] = rep
    return decomposed


def _settled(rep: str, table: dict[str, str]) -> str:
    """`rep`, which may hold look-alikes itself (a decomposed letter whose base is one), rewritten
    until nothing changes. Forms that lead back to each other end at the smallest of them."""
    seen: list[str] = []
    while rep not in seen:
        seen.append(rep)
        rep = "".join(table.get(c, c) for c in rep)
    return min(seen[seen.index(rep) :])


@lru_cache(maxsize=1)
def _unseen() -> dict[int, str | None]:
    """For str.translate: invisible characters out, any blank as a blank."""
    table: dict[int, str | None] = {9: " "}
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if invisible(ch):
            table[cp] = None
        elif blank(ch):
            table[cp] = " "
    return table


@lru_cache(maxsize=4)
def _automaton(items: frozenset[tuple[str, str]]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for s, rep in items:
        machine.add_word(s, (len(s), rep))
    machine.make_automaton()
    return machine


# A word with a character outside ASCII: no look-alike string reaches over a blank.
_WORD = re.compile("(?<!\\S)[\x00-\x08\x0e-\x1b!-\x7f]*+[^\x00-\x7f]\\S*")
_MEMO_WORDS = 200_000


class Rewriter:
    """Rewrites texts to their plain form; made from the class table, sent to the workers once."""

    def __init__(self, table: dict[str, str]):
        self.items = frozenset(table.items())
        self.memo: dict[str, str] = {}

    def __getstate__(self) -> dict:
        return {"items": self.items, "memo": {}}

    def _word(self, match: re.Match) -> str:
        word = match.group()
        plain = self.memo.get(word)
        if plain is None:
            out, at = [], 0
            for end, (size, rep) in _automaton(self.items).iter_long(word):
                out.append(word[at : end - size + 1])
                out.append(rep)
                at = end + 1
            out.append(word[at:])
            plain = "".join(out)
            if len(word) < 100:
                if len(self.memo) >= _MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = plain
        return plain

    def __call__(self, text: str) -> str:
        """The plain form: invisible characters left out, any blank as a blank, look-alikes as
        their representatives, accents composed (NFC)."""
        if text.isascii():
            return text.replace("\t", " ") if "\t" in text else text
        # Canonical decomposition first: composed and combining accents become the same.
        kept = unicodedata.normalize("NFD", text).translate(_unseen())
        return kept if kept.isascii() else unicodedata.normalize("NFC", _WORD.sub(self._word, kept))


def corpus_frequency(texts: DataFrame, column: str) -> dict[str, int]:
    """Number of occurrences of each non-ASCII character over all texts.

    Counted per batch and summed before the driver sees them; at most the size of Unicode.
    """

    ship(texts.sparkSession)
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        total: Counter = Counter()
        for pdf in batches:
            for text in pdf[column]:
                if text is not None and not text.isascii():
                    total.update(re.findall("[^\x00-\x7f]", text))
        yield pd.DataFrame({"ch": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    rows = texts.select(column).mapInPandas(count, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n")).collect()
    return {r.ch: r.n for r in rows}


def plain_form_rewriter(texts: DataFrame, column: str) -> Rewriter:
    """The rewriter for a corpus, with representatives by its frequencies."""
    return Rewriter(classes(look_alike_pairs(texts.sparkSession), corpus_frequency(texts, column)))


def plain_texts(docs: DataFrame, doc_id: str, text: str, rewriter: Rewriter) -> DataFrame:
    """(doc_id, plain): every text in its plain form. Null texts stay null."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(rewriter)

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            plain = [None if t is None else shared.value(t) for t in pdf[text]]
            yield pd.DataFrame({doc_id: pdf[doc_id], "plain": plain})

    return docs.select(doc_id, text).mapInPandas(rewrite, f"{doc_id} long, plain string")


def same_looking_classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_id, class_id): the documents whose text looks like a differently stored one.

    text_id is the smallest document with the same stored text, class_id the smallest one that looks
    the same. This is the compact form of `same_looking_pairs`: as many rows as documents, whatever
    the number of copies. Each document is reduced to 128-bit digests of its plain and its stored
    text; only classes of equal plain digests with at least two different stored texts go on.
    Null texts are in no class; empty text looks like text of invisible characters only. Document
    ids tell the documents; repeated rows count once.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(plain_form_rewriter(docs, text))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text].tolist()
            raw = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            plain = [
                r if t.isascii() and "\t" not in t
                else hashlib.blake2b(shared.value(t).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                for t, r in zip(texts, raw, strict=True)
            ]
            yield pd.DataFrame({"doc": pdf[doc_id], "raw": raw, "plain": plain})

    rows = docs.select(doc_id, text).where(F.col(text).isNotNull())
    rows = cut(rows.mapInPandas(digests, "doc long, raw binary, plain binary"))
    mixed = rows.groupBy("plain").agg(
        F.min("raw").alias("low"), F.max("raw").alias("high"), F.count(F.lit(1)).alias("n"), F.min("doc").alias("class_id")
    ).where("low <> high").select("plain", "class_id", "n")
    members = cut(salted_join(rows, mixed.drop("n"), ["plain"], "doc", hot_keys(mixed, ["plain"], "n")).select("doc", "raw", "class_id").distinct())
    # Equal stored texts have equal plain ones, so the stored text alone tells the copies.
    copies = members.groupBy("raw").agg(F.min("doc").alias("text_id"), F.count(F.lit(1)).alias("n"))
    named = salted_join(members, copies.drop("n"), ["raw"], "doc", hot_keys(copies, ["raw"], "n"))
    return named.select(F.col("doc").alias("doc_id"), "text_id", "class_id")


def same_looking_pairs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: pairs whose texts differ as stored but look the same.

    Different texts of a class are paired once and their copies put in afterwards, so byte-equal
    copies, which are no pair, are never compared with each other.
    """
    members = cut(same_looking_classes(docs, doc_id, text))
    texts = pairs_within(members.select("class_id", "text_id").distinct(), ["class_id"], "text_id", F.lit(True))
    doc = lambda name, key: members.select(F.col("text_id").alias(key), F.col("doc_id").alias(name))
    half = grid_join(texts.select("text_id_a", "text_id_b"), doc("a", "text_id_a"), ["text_id_a"], "text_id_b", "a")
    both = grid_join(half.select("a", "text_id_b"), doc("b", "text_id_b"), ["text_id_b"], "a", "b")
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
