"""Variant spellings of names typed by people.

Words that many names share (lines of business, given names) and their abbreviations and short forms
are learned from the names themselves: a word stands for a more frequent one if names that are equal
but for one word have mostly that one in its place. Names become such common words and distinctive
tokens. Candidates come from a prefix-filtered set-similarity join on token q-grams; they are verified
by a soft weighted token similarity in which rare tokens count more and every token must have its
counterpart; verified links are closed by connected components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.functions.skew import by_shuffle, hot_keys, pairs_within, salted_join
from provgraph.functions.text import is_blank, number_key
from provgraph.llm.components import components
from provgraph.runtime import cut, ship

# Legal forms without dots, and words around a name that don't belong to it.
LEGAL = set(
    "ag gmbh mbh ges gesmbh kg ohg ug se ltd limited sa sas sarl spa srl sl slu nv bv corp corporation inc incorporated "
    "co company llc llp lp plc oy ab as aps kft sro cokg gesellschaft".split()
)
AROUND = set("the messrs fa firma company dr ing prof mr mrs ms herr frau dipl sr sra mme".split())
# Given names and their short forms in everyday use. An optional table: short forms are
# learned as well where there are names enough; names beyond the table are compared as typed.
NICKNAMES = {
    "alexander": "alex sascha sasha xander lex alec", "bernadette": "berna detta bernie", "christian": "chris kit christ",
    "dorothea": "thea dora doro dorothy dot", "elisabeth": "lisa elli liz lizzy beth betty lisbeth elizabeth lis elise",
    "francesca": "franca fran cesca frances", "guillermo": "memo guille", "johannes": "hans hannes john jo johann",
    "katharina": "kate kathi kathy kati katja trina katherine", "leonhard": "leo lenny leonard len",
    "margarethe": "maggie greta grete gretel marga meg peggy margaret", "michael": "mike michi mick mikey",
    "nicholas": "nick klaus nico niklas nicolas nicky", "patricia": "pat trish patty tricia", "robert": "bob rob bert bobby robbie",
    "susanne": "susi sanne susie sue suse susan", "thomas": "tom tommy thom", "wilhelm": "will willi willy william bill billy helm",
    "andreas": "andy andi andrew", "josef": "sepp joe joseph", "stefan": "steve stephen steffen", "matthias": "matt matze",
    "maximilian": "max", "friedrich": "fritz fred", "benjamin": "ben", "daniel": "dan danny", "anthony": "tony toni antonio",
    "richard": "rick dick richie", "edward": "ed eddie ted", "charles": "charlie chuck carl karl", "victoria": "vicky viki",
}

#: q of the q-grams, least Jaccard similarity of the gram sets of a candidate, least soft similarity,
#: least similarity of each single token.
Q, CANDIDATE, ACCEPT, TOKEN = 3, 0.28, 0.8, 0.5
#: A word is common from this share of the names on, and from this number of names.
COMMON_SHARE, COMMON_NAMES = 0.001, 25
#: A short form is seen in the place of a common word so often, and mostly in the place of that one.
ALIAS_SEEN, ALIAS_SHARE = 3, 0.5
#: A common word is a line of business if at least this share of its names has a legal form.
LINE_SHARE = 0.1


def fold(text: str) -> str:
    """Lower case without accents; transcribed umlauts (ae, oe, ue) become plain vowels too."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return re.sub("([aou])e", r"\1", flat.replace("ß", "ss"))


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (swap of neighbours counts one), or most + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, last = [0] * 0, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


@dataclass
class Vocabulary:
    """Common words (True: a line of business, False: a given name) and what stands for them."""

    common: dict[str, bool] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    nicknames: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.memo: dict[str, str | None] = {}
        self.given = {fold(short): fold(full) for full, shorts in self.nicknames.items() for short in [full, *shorts]}
        # Words of six letters on may be mistyped: found by what is left of them without one or two letters.
        self.left: dict[str, set[str]] = {}
        for word in {*self.common, *(fold(n) for n in self.nicknames)}:
            for rest in _without_letters(word):
                self.left.setdefault(rest, set()).add(word)

    def mistyped(self, token: str) -> str | None:
        """The common word or given name that a token of six letters on is a typing error of."""
        if len(token) < 6:
            return None
        if token not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            near = {w for rest in _without_letters(token) for w in self.left.get(rest, ())}
            fits = [w for w in sorted(near) if edits(token, w, 2) <= (1 if len(w) < 9 else 2)]
            self.memo[token] = min(fits, key=lambda w: edits(token, w, 2), default=None)
        return self.memo[token]

    def line(self, token: str, short: bool) -> tuple[str, bool] | None:
        """The line of business that a token stands for, and whether it does so without a guess."""
        word = self.aliases.get(token, token)
        if self.common.get(word):
            return word, True
        if short and len(token) >= 3:
            longer = [w for w, is_line in self.common.items() if is_line and w.startswith(token)]
            if longer:
                return min(longer, key=lambda w: (self.aliases.get(w, w), w)), False
        word = self.mistyped(token)
        word = self.aliases.get(word, word)
        return (word, False) if word is not None and self.common.get(word) else None

    def given_name(self, token: str) -> str | None:
        word = self.aliases.get(token, token)
        if self.common.get(word) is not False and word not in self.given:
            word = self.mistyped(token)
            word = self.aliases.get(word, word)
            if word is None or (self.common.get(word) is not False and word not in self.given):
                return None
        return self.given.get(word, word)


def _without_letters(word: str) -> set[str]:
    """A word without one letter, a longer one also without two, and itself: two words that are at most so
    many typing errors apart have one of these in common."""
    out = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    if 7 <= len(word) <= 40:
        out |= {w[:i] + w[i + 1 :] for w in list(out) for i in range(len(w))}
    return out


def split_name(name: str) -> tuple[list[str], list[str], list[str], bool]:
    """(words, short words, initials, legal) of a name as typed: without legal forms and words around
    it; short words are those abbreviated with a dot."""
    text = re.sub(r"[\s\u200b\ufeff]+", " ", fold(name)).strip()
    words, shorts, singles, legal = [], [], [], False
    for t in re.split(r"[\s,/&()\-]+", text):
        word = re.sub(r"[^\w]", "", t)
        if not word:
            continue
        if word in LEGAL:
            legal = True
        elif len(word) == 1:
            singles.append(word)
        elif word not in AROUND:
            words.append(word)
            if t.endswith("."):
                shorts.append(word)
    if len(singles) > 1 and "".join(singles) in LEGAL:
        legal, singles = True, []
    return words, shorts, singles, legal


def parse_name(words: list[str], shorts: list[str], initials: list[str], legal: bool, vocabulary: Vocabulary) -> tuple[str, str, str, list[str], list[str]]:
    """(line, given, given as typed, tokens, short tokens) of a split name.

    line: a firm's line of business if it is a common one, else ''. given: a person's given name in
    its full form, an initial with a dot, or ''. tokens: all other words, sorted.
    """
    tokens = list(words)
    line, at = "", -1
    if len(tokens) > 1:
        for k, word in enumerate(tokens):
            found = vocabulary.line(word, word in shorts)
            if found and (not line or found[1]):
                line, at = found[0], k
        if line:
            tokens.pop(at)
    given, typed = "", ""
    if not line and not legal:
        for k, word in enumerate(tokens):
            if len(tokens) > 1 and (g := vocabulary.given_name(word)):
                given, typed = g, word
                tokens.pop(k)
                break
        else:
            if initials:
                given = initials[0] + "."
    return line, given, typed, sorted(tokens), sorted({w for w in shorts if w in tokens})


def grams(tokens: list[str]) -> list[tuple[str, int]]:
    """The q-grams of the tokens and their marked beginnings, each with the place of its token. A short
    token that stands alone has grams of two letters too: one typing error leaves it few of three."""
    found = {}
    for k, token in enumerate(tokens):
        t = "^" + token
        for q in (Q, Q - 1) if len(tokens) == 1 and len(token) <= 8 else (Q,):
            for i in range(max(1, len(t) - q + 1)):
                found.setdefault(t[i : i + q], k)
    return list(found.items())


@lru_cache(maxsize=100_000)
def _token_likeness(a: str, b: str, a_short: bool, b_short: bool) -> float:
    if a == b:
        return 1.0
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    if _abbreviates(x, y):
        return 0.9
    if a_short or b_short:
        if len(x) >= 3:
            off = min(edits(x, y[: len(x) + k], 1) for k in (-1, 0, 1))
            if off <= 1:
                return 0.95 - 0.15 * off
    longest = max(len(a), len(b))
    off = edits(a, b, longest // 3 + 1)
    return max(0.0, 1 - off / longest) if off <= longest // 3 + 1 else 0.0


def _abbreviates(x: str, y: str) -> bool:
    """A short word that has letters of a much longer one in order, the first and last among them."""
    if not 3 <= len(x) <= 5 or len(y) < 2 * len(x) or x[0] != y[0] or x[-1] != y[-1]:
        return False
    rest = iter(y)
    return all(c in rest for c in x)


def _aligned(a: list[str], b: list[str], a_short: set[str], b_short: set[str], wa: list[float], wb: list[float]) -> float:
    sims = sorted(
        ((_token_likeness(x, y, x in a_short, y in b_short), i, j) for i, x in enumerate(a) for j, y in enumerate(b)),
        key=lambda s: (-s[0], s[1], s[2]),
    )
    left, right, total, whole = set(), set(), 0.0, sum(wa) + sum(wb)
    for s, i, j in sims:
        if i not in left and j not in right:
            if s < TOKEN:
                return 0.0
            left.add(i)
            right.add(j)
            total += s * (wa[i] + wb[j])
    return total / whole if whole else 0.0


def likeness(a: list[str], b: list[str], a_short: list[str], b_short: list[str], wa: list[float], wb: list[float]) -> float:
    """Soft weighted token similarity: tokens are matched one to one, most alike first; each counts
    with its weight, so rare tokens count more. A token without a counterpart that is at least a
    little alike makes names different, however common it is. Two tokens typed without a blank
    between them are compared joined."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b, a_short, b_short, wa, wb = b, a, b_short, a_short, wb, wa
    short_a, short_b = set(a_short), set(b_short)
    if len(a) == len(b):
        return _aligned(a, b, short_a, short_b, wa, wb)
    best = 0.0
    # Long names aren't joined: each pair of words would have to be tried.
    if len(b) == len(a) + 1 and len(b) <= 6:
        for i in range(len(b)):
            for j in range(len(b)):
                if i != j:
                    rest = [k for k in range(len(b)) if k not in (i, j)]
                    joined, weights = [b[i] + b[j], *(b[k] for k in rest)], [wb[i] + wb[j], *(wb[k] for k in rest)]
                    best = max(best, _aligned(a, joined, short_a, short_b, wa, weights))
    return best


def given_fits(a: str, b: str) -> str:
    """'yes', 'no', or 'maybe' where only an initial or no given name is there."""
    if a == b:
        return "yes" if a else "maybe"
    if not a or not b:
        return "maybe"
    if a.endswith(".") or b.endswith("."):
        return "maybe" if a[0] == b[0] else "no"
    return "yes" if min(len(a), len(b)) >= 5 and edits(a, b, 1) <= 1 else "no"


@dataclass
class Name:
    """A parsed name, as it is compared."""

    given: str
    typed: str
    tokens: list[str]
    shorts: list[str]
    weights: list[float]


def _likeness_of(a: Name, b: Name) -> float:
    return likeness(a.tokens, b.tokens, a.shorts, b.shorts, a.weights, b.weights)


def _with_given(n: Name) -> Name:
    return Name("", "", [*n.tokens, n.typed], n.shorts, [*n.weights, sum(n.weights) / max(1, len(n.weights))])


def compared(a: Name, b: Name) -> str:
    """'yes' if two names of one line of business (or none) are alike, 'maybe' where only an initial or
    no given name speaks for a person, else 'no'."""
    fit = given_fits(a.given, b.given)
    if fit != "no" and _likeness_of(a, b) >= ACCEPT:
        # Names without any given name on both sides are compared by all their words.
        return "yes" if fit == "yes" or not a.given and not b.given else "maybe"
    for x, y in ((a, b), (b, a)):
        # A given name that isn't known as one is among the tokens.
        if not y.given and x.typed and _likeness_of(_with_given(x), y) >= ACCEPT:
            return "yes"
        if not y.given and x.given.endswith(".") and len(y.tokens) == len(x.tokens) + 1:
            for k, token in enumerate(y.tokens):
                rest = Name("", "", y.tokens[:k] + y.tokens[k + 1 :], y.shorts, y.weights[:k] + y.weights[k + 1 :])
                if token[0] == x.given[0] and _likeness_of(x, rest) >= ACCEPT:
                    return "maybe"
    return "no"


def _shorter(a: Name, b: Name) -> bool:
    """Whether `a` is the end of a doubtful link that lacks the given name: the one with an initial, or
    without any where the other has one."""
    return a.given.endswith(".") or (not a.given and not b.given.endswith("."))


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = pd.DataFrame([split_name(n) for n in pdf["name"]], columns=["words", "shorts", "initials", "legal"])
        out.insert(0, "name", pdf["name"].to_numpy())
        yield out


_SPLIT = "name string, words array<string>, shorts array<string>, initials array<string>, legal boolean"


def learned_vocabulary(split: DataFrame, nicknames: dict[str, list[str]]) -> Vocabulary:
    """The common words of split names and the short forms that stand for them.

    Counts cover all names and are made where the data is. What reaches the driver is bounded: a word
    of a share of all names by the inverse of the share times the words of a name, a short form by
    the same with its own least share (a hundredth of that).
    """
    n = split.count()
    distinct = split.select("legal", F.array_distinct("words").alias("ws"))
    counts = cut(distinct.select("legal", F.explode("ws").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.count_if("legal").alias("n_legal")))
    common = counts.where(F.col("df") >= max(COMMON_NAMES, COMMON_SHARE * n))
    words = {r.word: (r.df, r.n_legal) for r in common.collect()}
    if not words:
        return Vocabulary({}, {}, nicknames)
    # The words of a name but one, as the combined hash of them: names that differ in one word share it.
    whole = F.aggregate("ws", F.lit(0).cast("long"), lambda h, w: h.bitwiseXOR(F.xxhash64(w)))
    placed = distinct.where(F.size("ws") >= 3).withColumn("h", whole)
    placed = placed.select(F.inline(F.transform("ws", lambda w: F.struct(w.alias("word"), F.col("h").bitwiseXOR(F.xxhash64(w)).alias("rest"))))).distinct()
    # Only a few words can stand in the place of one rest and be common.
    places = placed.join(F.broadcast(common.select(F.col("word").alias("for_word"))), F.col("word") == F.col("for_word")).select("rest", "for_word")
    seen = salted_join(placed, places, ["rest"], "word", hot_keys(placed, ["rest"]), large=True).where("word <> for_word")
    seen = seen.groupBy("word", "for_word").agg(F.count(F.lit(1)).alias("n"))
    best = seen.groupBy("word").agg(F.sum("n").alias("total"), F.max(F.struct("n", "for_word")).alias("b")).select("word", "total", "b.*")
    best = best.where((F.col("n") >= max(ALIAS_SEEN, COMMON_SHARE / 100 * n)) & (F.col("n") >= ALIAS_SHARE * F.col("total"))).join(by_shuffle(counts), "word")
    aliases = {r.word: r.for_word for r in best.collect() if r.df < words[r.for_word][0]}
    # What stands for a short form stands for what that stands for.
    for word in aliases:
        while aliases.get(aliases[word]) not in (None, word):
            aliases[word] = aliases[aliases[word]]
    return Vocabulary({w: legal >= LINE_SHARE * df for w, (df, legal) in words.items()}, aliases, nicknames)


def name_links(names: DataFrame, nicknames: dict[str, list[str]] = NICKNAMES) -> tuple[DataFrame, DataFrame]:
    """(records, links) for a frame with a column `name` (distinct, not blank).

    records: (name, sig), the signature of each name; links: (a, b, sure, a_short, b_short) between
    signatures that are alike; `sure` is false where only an initial, or no given name, speaks for
    a person, and the short ends are those without a full given name.
    """
    spark = names.sparkSession
    ship(spark)
    # Parsing costs far more than reading, so rows are spread over all tasks first.
    split = cut(names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(_split, _SPLIT))
    shared = spark.sparkContext.broadcast(learned_vocabulary(split, {full: v.split() if isinstance(v, str) else v for full, v in nicknames.items()}))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = zip(*(pdf[c] for c in ("words", "shorts", "initials", "legal")), strict=True)
            parsed = [parse_name(list(w), list(s), list(i), bool(g), shared.value) for w, s, i, g in cells]
            out = pd.DataFrame(parsed, columns=["line", "given", "typed", "tokens", "shorts"])
            out.insert(0, "name", pdf["name"].to_numpy())
            # Exact copies in parsed form share a signature and are compared once.
            # A name without any token is only like one that is written the same.
            out["sig"] = ["|".join((*p[:3], " ".join(p[3]), " ".join(p[4]))) if p[3] else f"|{' '.join(fold(n).split())}" for p, n in zip(parsed, pdf["name"], strict=True)]
            out["grams"] = [[{"gram": f"{p[0]}|{g}", "token": k} for g, k in grams(p[3])] for p in parsed]
            yield out

    parsed = cut(split.mapInPandas(parse, "name string, line string, given string, typed string, tokens array<string>, shorts array<string>, sig string, grams array<struct<gram:string,token:int>>"))
    records = parsed.dropDuplicates(["sig"]).drop("name").withColumn("rid", F.xxhash64("sig"))
    postings = records.select("rid", "sig", F.inline("grams"))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    weighted = salted_join(postings, counts, ["gram"], "sig", hot_keys(counts, ["gram"], "df"), large=True)
    n = records.count()
    # Rarest grams first, one order for all records; a token weighs as its grams are rare.
    per_token = weighted.groupBy("sig", "token").agg(
        F.avg(F.log(1 + F.lit(float(n)) / F.col("df"))).alias("weight"), F.collect_list(F.struct("df", F.xxhash64("gram").alias("g"))).alias("g")
    )
    ordered = per_token.groupBy("sig").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("token", "weight"))), lambda x: x["weight"]).alias("weights"),
        F.transform(F.sort_array(F.flatten(F.collect_list("g"))), lambda x: x["g"]).alias("set"),
    )
    full = cut(records.drop("grams", "line").join(by_shuffle(ordered), "sig"))
    # Only numbers go through the join: gram, record and size of the set.
    size = F.size("set")
    prefix = (size - F.ceil(F.lit(CANDIDATE) * size) + 1).cast("int")
    keys = full.select("rid", size.alias("size"), F.explode(F.slice("set", F.lit(1), prefix)).alias("key"))
    need = F.ceil(F.lit(CANDIDATE / (1 + CANDIDATE)) * (F.col("size_a") + F.col("size_b")))
    fits = F.least("size_a", "size_b") >= F.lit(CANDIDATE) * F.greatest("size_a", "size_b")
    met = pairs_within(keys, ["key"], "rid", fits)
    # What the prefixes share and what may be shared beyond the longer rest must come to the needed overlap.
    # This takes all common grams of a pair, so a filter by the places of single ones can't go before it.
    beyond = F.greatest(*(F.ceil(F.lit(CANDIDATE) * F.col(f"size_{x}")) - 1 for x in "ab"))
    pairs = met.groupBy(F.least("rid_a", "rid_b").alias("rid"), F.greatest("rid_a", "rid_b").alias("rid_b")).agg(
        F.count(F.lit(1)).alias("n"), F.first(need).alias("need"), F.first(beyond).alias("beyond")
    ).where("n + beyond >= need").select("rid", "rid_b")
    other = full.select(*(F.col(c).alias(f"{c}_b") for c in full.columns))
    shared_grams = F.size(F.array_intersect("set", "set_b"))
    alike = shared_grams >= F.lit(CANDIDATE) * (F.size("set") + F.size("set_b") - shared_grams)
    found = pairs.join(by_shuffle(full), "rid").join(by_shuffle(other), "rid_b").where(alike).drop("set", "set_b", "rid", "rid_b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ("given", "typed", "tokens", "shorts", "weights")
        for pdf in batches:
            sides = [[Name(g, t, list(w), list(s), list(x)) for g, t, w, s, x in zip(*(pdf[c + e] for c in columns), strict=True)] for e in ("", "_b")]
            fit = [compared(a, b) for a, b in zip(*sides, strict=True)]
            short = {c: [_shorter(x, y) for x, y in zip(*pair, strict=True)] for c, pair in (("a_short", sides), ("b_short", sides[::-1]))}
            keep = [f != "no" for f in fit]
            yield pd.DataFrame({"a": pdf["sig"], "b": pdf["sig_b"], "sure": [f == "yes" for f in fit], **short})[keep]

    return parsed.select("name", "sig"), found.mapInPandas(verify, "a string, b string, sure boolean, a_short boolean, b_short boolean")


def same_entities(vendors: DataFrame, number: str, name: str) -> DataFrame:
    """(lifnr_a, lifnr_b), smaller first, for all pairs of different numbers of one entity.

    Numbers are compared trimmed, without leading zeros; rows with a blank name don't count. Firms
    with different lines of business and persons with different given names are different. An
    abbreviated given name joins a group only if all it is like lies in one group. Copies of a
    name are compared once and stay linked through their signature. No rows give no pairs.
    """
    rows = vendors.where(~is_blank(F.col(name)) & ~is_blank(F.col(number))).select(
        number_key(F.col(number)).alias("num"), F.col(name).alias("name")
    )
    records, links = name_links(rows.select("name").distinct())
    links = cut(links)
    records = cut(records.join(by_shuffle(rows), "name").select("num", "sig").distinct())
    node = records.select(F.concat(F.lit("n:"), "num").alias("a"), F.concat(F.lit("s:"), "sig").alias("b"))
    sure = links.where("sure").select(F.concat(F.lit("s:"), "a").alias("a"), F.concat(F.lit("s:"), "b").alias("b"))
    groups = cut(components(node.unionByName(sure)))
    doubtful = links.where(~F.col("sure"))
    sides = [doubtful.where(f"{x}_short").select(F.concat(F.lit("s:"), x).alias("x"), F.concat(F.lit("s:"), y).alias("y")) for x, y in ("ab", "ba")]
    maybe = sides[0].unionByName(sides[1])
    for end in ("x", "y"):
        maybe = maybe.join(by_shuffle(groups.select(F.col("id").alias(end), F.col("group_id").alias(f"g{end}"))), end)
    # A group with a short given name joins the one group it is like; if there are several, none.
    only = maybe.where("gx <> gy").groupBy("gx").agg(F.min("gy").alias("a"), F.max("gy").alias("b")).where("a = b")
    extra = only.select("a", F.col("gx").alias("b"))
    merged = components(extra).select(F.col("id").alias("group_id"), F.col("group_id").alias("merged"))
    groups = groups.join(by_shuffle(merged), "group_id", "left").select("id", F.coalesce("merged", "group_id").alias("group_id"))
    numbers = cut(groups.where(F.col("id").startswith("n:")).select(F.substr("id", F.lit(3)).alias("num"), "group_id"))
    pairs = pairs_within(numbers.distinct(), ["group_id"], "num", F.lit(True))
    return pairs.select(F.least("num_a", "num_b").alias("lifnr_a"), F.greatest("num_a", "num_b").alias("lifnr_b"))
