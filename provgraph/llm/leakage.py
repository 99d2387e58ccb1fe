"""Evaluation texts leaking into training text.

Texts become sequences of plain words, words become 64-bit hashes. Windows of half the least leak are
embedded by CGK random walks, which map edit distance to Hamming distance; windows that agree on
sampled positions of one of several embeddings are candidates, with as many repetitions as a target
recall for edited windows takes. A candidate is verified by the exact edit distance of its windows and
then aligned on the words around them; that at least so many words are equal in a row is the last filter.

The items are the stated query set: each block of them is searched for in all documents without a
shuffle, and documents are parsed once however many blocks there are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.lookalike import Rewriter
from provgraph.runtime import cut, ship

#: Texts whose windows are embedded at once.
BATCH_TEXTS = 500
#: Items are searched for in blocks of at most so many; a block's tables are broadcast (about 15 kB an item).
BLOCK_ITEMS = 5_000
#: A macro whose whole text would be longer than this (nested doubling) stays a command.
MACRO_CHARS = 1_000_000

# Commands whose argument names something and isn't read as text.
_NAMING = "cite[a-zA-Z]*|[a-zA-Z]*ref|label|begin|end|includegraphics|input|include|bibliography|bibliographystyle|usepackage|documentclass|index|vspace|hspace|color|textcolor|url"
_ACCENT = re.compile(r"""\\["'`^~=.]\s*\{?\\?([A-Za-z])\}?|\\[cvuHkrbdt]\s*\{([A-Za-z])\}""")
_SPECIAL = re.compile(r"\\(ss|ae|oe|aa|o|l|i|j|AE|OE|AA|O|L)(?![A-Za-z])\s*(?:\{\})?")
_LETTERS = {"aa": "a", "AA": "A"}
_OPTIONAL = re.compile(r"\\[-/]")
_JOINED = re.compile(r"-(?<=\w-)[ \t]*\r?\n[ \t%]*(?=\w)")
_USED = re.compile(r"(\\[a-zA-Z]+)(?:\{\})?")
_NAMED = re.compile(rf"\\(?:{_NAMING})(?![a-zA-Z])\*?(?:\s*\[[^\]]*\])?(?:\s*\{{[^{{}}]*\}})?")
_COMMAND = re.compile(r"\\[a-zA-Z]+\*?|\\.", re.S)
_MACRO = re.compile(r"\\(?:(?:re)?newcommand\*?\s*\{?\s*(\\[a-zA-Z]+)\s*\}?\s*(?:\[0\])?|def\s*(\\[a-zA-Z]+))\s*\{")
_BRACE = re.compile(r"[{}]")
_DROP = {c: None for c in range(128) if not (chr(c).isalnum() or chr(c).isspace())} | {ord("~"): " "}


def _macros(text: str) -> tuple[dict[str, str], str]:
    """The macros without arguments that a text defines, and the text without the definitions. Braces
    are matched in one pass, nested to any depth; a definition without its closing brace is none."""
    closing, stack = {}, []
    for m in _BRACE.finditer(text):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            closing[stack.pop()] = m.start()
    macros, kept, at = {}, [], 0
    for m in _MACRO.finditer(text):
        end = closing.get(m.end() - 1)
        if m.start() >= at and end is not None:
            macros[m.group(1) or m.group(2)] = text[m.end() : end]
            kept.append(text[at : m.start()])
            at = end + 1
    kept.append(text[at:])
    return macros, " ".join(kept)


def _resolved(macros: dict[str, str]) -> dict[str, str]:
    """Each macro with its whole text: macros in its body replaced, to any depth. Where definitions go
    in a circle the name that closes it stays a command, and so does a name whose text would get
    longer than MACRO_CHARS."""
    done: dict[str, str] = {}
    for first in macros:
        path, open_names = [first], set()
        while path:
            name = path[-1]
            if name in done:
                path.pop()
                continue
            open_names.add(name)
            needs = [n for n in dict.fromkeys(_USED.findall(macros[name])) if n in macros and n not in done and n not in open_names]
            if needs:
                path.extend(needs)
                continue
            size = sum(len(done.get(n, "")) for n in _USED.findall(macros[name]))
            body = macros[name] if size > MACRO_CHARS else _USED.sub(lambda m: done.get(m.group(1), m.group()), macros[name])
            done[name] = body
            open_names.discard(name)
            path.pop()
    return done


def plain_words(text: str, rewriter: Rewriter) -> list[str]:
    """The words of a text without case, punctuation, line breaks, markup, comment signs, accents
    and disguise. Punctuation inside a word is left out ('9.5' is '95'); words cut at a line end or
    by a discretionary hyphen are joined; macros of the text without arguments are replaced by
    their text; arguments of commands count as text unless they only name something."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", rewriter(text))
        text = "".join(c for c in text if not unicodedata.combining(c)).replace("ß", "ss")
    if "\\" in text:
        if "\\def" in text or "newcommand" in text:
            macros, rest = _macros(text)
            if macros:
                whole = _resolved(macros)
                text = _USED.sub(lambda m: whole.get(m.group(1), m.group()), rest)
        text = _ACCENT.sub(lambda m: m.group(1) or m.group(2), text)
        text = _SPECIAL.sub(lambda m: _LETTERS.get(m.group(1), m.group(1)), text)
        text = _OPTIONAL.sub("", text)
        text = _NAMED.sub(" ", text)
        text = _COMMAND.sub(" ", text)
    text = _JOINED.sub("", text)
    text = text.translate(_DROP).lower()
    if not text.isascii():
        text = "".join(c if c.isalnum() or c.isspace() else "" for c in text)
    return text.split()


class _Hashes(dict):
    """word -> 64-bit hash, never 0 (which stands for the end of a text); emptied when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        return h


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def coded(text: str, rewriter: Rewriter) -> np.ndarray:
    h = _hashes()
    return np.array([h[w] for w in plain_words(text, rewriter)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def embed(windows: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """CGK embedding of rows of symbols: at each of the steps the current symbol is put out and the walk
    moves on if the random bit of step and symbol (a bit of their mixed hash) is set; past the end of
    the window it puts out 0."""
    n, width = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), dtype=np.uint64)], axis=1).ravel()
    base, place = np.arange(n) * (width + 1), np.zeros(n, dtype=np.int64)
    out = np.empty((len(steps), n), dtype=np.uint64)
    for j, step in enumerate(steps):
        symbol = padded[base + place]
        out[j] = symbol
        place += ((_mixed(symbol ^ step) >> np.uint64(63)).astype(np.int64)) & (place < width)
    return out.T


@dataclass(frozen=True)
class Lsh:
    """Random steps of one embedding per repetition and the positions sampled from it."""

    window: int
    edits: int
    steps: np.ndarray
    samples: np.ndarray

    def keys(self, windows: np.ndarray, only: int | None = None) -> np.ndarray:
        """One 64-bit key per repetition (rows) and window."""
        chosen = range(len(self.steps)) if only is None else [only]
        out = np.empty((len(chosen), len(windows)), dtype=np.uint64)
        for i, r in enumerate(chosen):
            embedded = embed(windows, self.steps[r])
            h = np.full(len(windows), 0x9E3779B97F4A7C15 + r, dtype=np.uint64)
            for p in self.samples[r]:
                h = _mixed(h ^ embedded[:, p]) * np.uint64(0xC4CEB9FE1A85EC53)
            out[i] = h
        return out


def edited_windows(windows: np.ndarray, edits: int, random: np.random.Generator) -> np.ndarray:
    """Windows with so many words replaced, put in or left out at random places, and new words after."""
    out = np.zeros_like(windows)
    width = windows.shape[1]
    for i, row in enumerate(windows):
        r = row.tolist()
        for _ in range(edits):
            kind, at = random.integers(0, 3), int(random.integers(0, len(r)))
            new = [int(random.integers(1, 2**62))]
            r[at : at + (kind != 1)] = [] if kind == 2 else new
        r += random.integers(1, 2**62, width).tolist()
        out[i] = r[:width]
    return out


@lru_cache(maxsize=8)
def make_lsh(window: int, edits: int, target: float, sampled: int, seed: int) -> Lsh:
    """As many repetitions as bring windows with so many edits together with probability `target`.

    That share is measured on 2,000 made-up pairs of windows (seeded), for growing numbers of
    repetitions. Equal windows meet in every repetition. Each repetition has an embedding of its own
    and one position from each of `sampled` equal stretches of it.
    """
    random = np.random.default_rng(seed)
    length, most = 2 * window, 96
    steps = random.integers(1, 2**63, (most, length), dtype=np.uint64)
    cuts = np.linspace(0, length, sampled + 1).astype(int)
    samples = np.stack([random.integers(cuts[:-1], cuts[1:]) for _ in range(most)])
    probe = random.integers(1, 2**62, (2_000, window), dtype=np.uint64)
    other = edited_windows(probe, edits, random)
    apart = np.ones(len(probe), dtype=bool)
    for r in range(most):
        one = Lsh(window, edits, steps[r : r + 1], samples[r : r + 1])
        apart &= (one.keys(probe) != one.keys(other))[0]
        if apart.mean() <= 1 - target:
            return Lsh(window, edits, steps[: r + 1], samples[: r + 1])
    raise ValueError(f"more than {most} repetitions for a recall of {target} at {edits} edits in {window} words; sample fewer positions")


def _pairs(words: np.ndarray) -> np.ndarray:
    """A hash of each two neighbouring words."""
    return _mixed(words[..., :-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[..., 1:])


@dataclass(frozen=True)
class Search:
    """What a block of items is searched with; sent to the workers once."""

    rewriter: Rewriter
    lsh: Lsh
    least: int
    items: list[tuple[int, np.ndarray]]
    known: np.ndarray
    windows: np.ndarray
    at_item: np.ndarray
    at_place: np.ndarray
    keys: np.ndarray
    order: np.ndarray


def make_search(items: list[tuple[int, str]], rewriter: Rewriter, lsh: Lsh, least: int) -> Search:
    """The tables for items (id, passage): every window of every item of at least `least` words, its
    keys sorted per repetition, and a bitmap of the items' neighbouring words."""
    texts = [(i, coded(t, rewriter)) for i, t in items]
    texts = [(i, t) for i, t in texts if len(t) >= least]
    views = [np.lib.stride_tricks.sliding_window_view(t, lsh.window) for _, t in texts]
    windows = np.concatenate(views) if views else np.empty((0, lsh.window), dtype=np.uint64)
    at_item = np.repeat(np.arange(len(views)), [len(v) for v in views])
    at_place = np.concatenate([np.arange(len(v)) for v in views]) if views else at_item
    pairs = np.concatenate([_pairs(t) for _, t in texts]) if views else np.empty(0, dtype=np.uint64)
    bits = 1 << max(12, math.ceil(math.log2(32 * len(pairs) + 1)))
    known = np.zeros(bits // 64, dtype=np.uint64)
    at = pairs & np.uint64(bits - 1)
    np.bitwise_or.at(known, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    keys = lsh.keys(windows)
    order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
    return Search(rewriter, lsh, least, texts, known, windows, at_item, at_place, np.take_along_axis(keys, order, axis=1), order)


def _in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bitmap) * 64 - 1)
    return ((bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def window_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """For each row the least number of edited words between `b` and a beginning of `a`, which is `most`
    words longer (0 past the end of a text), by a band of the dynamic program; more than `most` if
    there are more."""
    n, width = b.shape
    far = np.full(n, width + most + 1, dtype=np.int16)
    last = {j: np.full(n, j, dtype=np.int16) for j in range(most + 1)}
    for i in range(1, width + 1):
        row = {}
        for j in range(max(0, i - most), i + most + 1):
            if j == 0:
                row[0] = np.full(n, i, dtype=np.int16)
                continue
            best = last.get(j - 1, far) + (a[:, j - 1] != b[:, i - 1])
            row[j] = np.minimum(best, np.minimum(last.get(j, far), row.get(j - 1, far)) + 1).astype(np.int16)
        last = row
    return np.minimum.reduce([last[j] for j in range(width - most, width + most + 1)])


def longest_run(a: np.ndarray, i: int, b: np.ndarray, j: int, band: int) -> int:
    """Most equal words in a row on the diagonals through (i, j) and up to `band` beside it."""
    best = 0
    for shift in range(-band, band + 1):
        back = min(i + shift, j)
        if back < 0:
            continue
        x, y = a[i + shift - back :], b[j - back :]
        n = min(len(x), len(y))
        wrong = np.flatnonzero(x[:n] != y[:n])
        edges = np.concatenate([[-1], wrong, [n]])
        best = max(best, int((np.diff(edges) - 1).max()))
    return best


def aligned_words(a: list[int], i: int, b: list[int], j: int, band: int, price: int) -> int:
    """Equal words in the best local alignment around the diagonal through (i, j): an equal word counts
    1, an edited one -price; among equal scores the one with more equal words."""
    low = i - j - band
    last = [(0, 0)] * (2 * band + 3)
    best = (0, 0)
    for q in range(len(b)):
        row = [(0, 0)] * (2 * band + 3)
        for d in range(1, 2 * band + 2):
            p = q + low + d - 1
            if not 0 <= p < len(a):
                continue
            score, equal = last[d]
            same = (score + 1, equal + 1) if a[p] == b[q] else (score - price, equal)
            row[d] = max(same, (last[d + 1][0] - price, last[d + 1][1]), (row[d - 1][0] - price, row[d - 1][1]), (0, 0))
        best = max(best, max(row))
        last = row
    return best[1]


#: An edited word of an alignment costs as much as so many equal ones bring.
EDIT_PRICE = 10


def leaks_of(docs: list[np.ndarray], s: Search) -> list[tuple[int, int, int, int]]:
    """(text, item id, run_words, near_words) for each text (as word hashes) and item with windows alike."""
    lsh, w, k = s.lsh, s.lsh.window, s.lsh.edits
    if not s.items:
        return []
    parts = [d[: len(d) // w * w].reshape(-1, w) for d in docs]
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    place = np.concatenate([np.arange(len(x)) * w for x in parts])
    windows = np.concatenate(parts)
    # An edit makes at most two pairs of neighbouring words that the item doesn't have.
    likely = np.flatnonzero((~_in_bitmap(s.known, _pairs(windows))).sum(axis=1) <= 2 * k)
    chosen, met = windows[likely], []
    for r in range(len(lsh.steps)):
        keys = lsh.keys(chosen, r)[0]
        low, high = (np.searchsorted(s.keys[r], keys, side=side) for side in ("left", "right"))
        n = high - low
        c = np.repeat(np.arange(len(keys)), n)
        m = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        met.append(c.astype(np.int64) * len(s.windows) + s.order[r][m])
    met = np.unique(np.concatenate(met))
    c, m = likely[met // len(s.windows)], met % len(s.windows)
    # The document's window and the words after it, as many as edits may take up.
    flat = np.concatenate([*docs, np.zeros(w + k, dtype=np.uint64)])
    start = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    at = start[owner[c]] + place[c]
    steps = np.arange(w + k)
    ahead = np.where(at[:, None] + steps < start[owner[c] + 1][:, None], flat[at[:, None] + steps], np.uint64(0))
    alike = np.flatnonzero(window_distances(ahead, s.windows[m], k) <= k)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    seen: set[tuple[int, int, int]] = set()
    for x in alike.tolist():
        t, p, item, q = int(owner[c[x]]), int(place[c[x]]), int(s.at_item[m[x]]), int(s.at_place[m[x]])
        run, near = best.get((t, item), (0, 0))
        # Windows on one diagonal see the same words: each diagonal is aligned once.
        if (t, item, p - q) in seen:
            continue
        seen.add((t, item, p - q))
        words = s.items[item][1]
        first = max(0, p - q - k)
        doc = docs[t][first : p - q + len(words) + k]
        new = longest_run(doc, p - first, words, q, k)
        run = max(run, new)
        if run < s.least:
            near = max(near, aligned_words(doc.tolist(), p - first, words.tolist(), q, k, EDIT_PRICE))
        best[(t, item)] = (run, max(run, near))
    return [(t, s.items[item][0], run, near) for (t, item), (run, near) in best.items()]


def _blocks(rows) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    for r in rows:
        block.append((r[0], r[1]))
        if len(block) == BLOCK_ITEMS:
            yield block
            block = []
    if block:
        yield block


def leaked_passages(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, rewriter: Rewriter,
    least: int = 22, edits: int = 1, target: float = 0.9, sampled: int = 6, seed: int = 17,
) -> DataFrame:
    """(doc_id, item_id, run_words, near_words): documents that hold a window of an item, as `plain_words`
    reads both, with up to `edits` edited words in half a least leak.

    run_words: most equal words in a row; near_words: equal words of the best alignment in which an
    edit costs EDIT_PRICE equal words (the run itself, if it is a leak). Each run of `least` equal words
    is found, whatever the chance: it holds a whole window at a multiple of the window's length, and
    equal windows meet in every repetition. A window with `edits` edits is found with a probability
    of `target`. Null and short texts and passages match nothing; of repeated item ids each passage
    counts; an empty table gives an empty result. More items than a block holds take further passes
    over the documents' words, which are then parsed and stored once.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    lsh = make_lsh(least // 2, edits, target, sampled, seed)
    rows = items.where(F.col(passage).isNotNull()).select(item_id, passage).orderBy(item_id, passage)
    schema = "doc_id long, item_id long, run_words int, near_words int"
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("content"))
    blocks = _blocks(rows.toLocalIterator())
    block, following = next(blocks, []), next(blocks, None)
    fused = following is None

    if not fused:
        shared = sc.broadcast(rewriter)

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": [coded(t, shared.value).view(np.int64) for t in pdf["content"]]})

        texts = cut(texts.mapInPandas(code, "doc_id long, content array<long>"))

    out = docs.sparkSession.createDataFrame([], schema)
    while block:
        search = sc.broadcast(make_search(block, rewriter, lsh, least))

        def scan(batches: Iterator[pd.DataFrame], search=search) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids, contents = pdf["doc_id"].tolist(), pdf["content"].tolist()
                for at in range(0, len(ids), BATCH_TEXTS):
                    some = contents[at : at + BATCH_TEXTS]
                    words = [coded(t, search.value.rewriter) if fused else np.asarray(t, dtype=np.int64).view(np.uint64) for t in some]
                    found = [(ids[at + t], item, run, near) for t, item, run, near in leaks_of(words, search.value)]
                    yield pd.DataFrame(found, columns=["doc_id", "item_id", "run_words", "near_words"]).astype({"doc_id": "int64", "item_id": "int64", "run_words": "int32", "near_words": "int32"})

        out = out.unionByName(texts.mapInPandas(scan, schema))
        block, following = following, next(blocks, None)
    # An item id may stand in several blocks.
    return out.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.max("near_words").alias("near_words"))


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, rewriter: Rewriter, least: int = 22, **more) -> DataFrame:
    """(doc_id, item_id): each document with an item of whose passage it holds at least `least` words in
    a row; see `leaked_passages`."""
    found = leaked_passages(docs, doc_id, text, items, item_id, passage, rewriter, least, **more)
    return found.where(F.col("run_words") >= least).select("doc_id", "item_id")
