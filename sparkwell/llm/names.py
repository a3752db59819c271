"""Variant spellings of names: which records mean the same person or organisation.

A name is taken apart into its core (what the organisation is called, or the
surname), a first name, a trade and codes (words with figures, words of places); legal forms, titles and
remarks in brackets are left out. The word lists are a parameter. Core words are folded: case, diacritics,
doubled letters and letters often written for one another. Equal forms become one representative at once.

Suffix blocking finds candidates. Every core word is indexed by its suffixes above a
minimum length, and so are its consonants and those of the whole core in either order of its
words, which a wrong vowel or a swap of neighbours leaves as they are. A suffix of
more than `common` representatives isn't used as it is: it is refined with the
consonants of the rest of the core, at its start and at its end, as often as it takes. Candidates are
compared by the ratio of their longest common subsequence, in either order of words;
first names (with nicknames and initials), trades and codes must not contradict, nor may a
name that tells neither join two organisations of different trades. Links are
closed to classes by alternating large-star and small-star steps.

Defined results: null and blank names link to nothing, and have no class. Every other name has one.
Equal names are linked, also those of titles, legal forms, first names or marks only.
Customers and entities are never compared with each other. Repeated rows count once. Empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import use_shared_checkpoints

SUFFIX, SKELETON, COMMON = 4, 5, 12
#: How often a block that stays large is refined, each time with two more consonants of either end.
LEVELS = 4
#: Blocks to refine whose keys are sent to tasks; more are joined.
MOST_LARGE = 100_000
#: A refined block may be so many times as large before it is refined again: that parts more of the misspelt.
DEEPER = 10

# Fixed values, the defaults of `Words`: nicknames by first name; legal forms; trades with their short forms; titles; words of places.
NICKNAMES = {
    "alexander": "alex sascha sandy xander", "alexandra": "alex sascha sandra lexi", "andreas": "andi andy", "anthony": "tony ant", "antonia": "toni nia", "bartholomew": "bart barty", "benedikt": "bene ben",
    "benjamin": "ben benny", "catherine": "cathy kate katie cat", "christopher": "chris kit topher", "daniel": "dan danny", "dorothea": "dora thea", "edward": "ed eddie ted ned", "elisabeth": "lisa ela betty liz elsa",
    "elizabeth": "liz beth betty eliza lizzie", "emmanuel": "manu emil", "frederick": "fred freddy", "frederike": "rike freddy", "friedrich": "fritz fred", "gabriele": "gabi ela", "heinrich": "heinz heiner", "james": "jim jimmy jamie",
    "johannes": "hannes hans jo", "john": "jack johnny", "josef": "sepp jupp", "joseph": "joe joey", "josephine": "josie fina", "katharina": "kati kathi kate", "konstantin": "konni kosta", "leopold": "leo poldi",
    "magdalena": "lena magda", "margaret": "maggie meg peggy", "margarethe": "greta grete", "matthew": "matt", "maximilian": "max maxi", "michael": "mike mick micha", "mohammed": "mohamed muhammad mo", "nathaniel": "nat nate",
    "nicholas": "nick nico", "patricia": "pat patty trish", "raphael": "rafa raffi", "richard": "rick dick richie", "robert": "bob rob bobby robbie", "rosalinde": "rosa linde", "samuel": "sam sammy", "sebastian": "basti seb",
    "stephan": "steffen steve", "susanne": "susi sanne", "theodor": "theo teddy", "thomas": "tom tommy", "valentin": "val valti", "wilhelm": "willi willy", "wilhelmina": "willa mina", "william": "bill billy will liam",
}
LEGAL = "gmbh mbh gesellschaft ag aktiengesellschaft inc incorporated ltd limited sa soc societe anonyme co kg and und plc llc llp corp corporation company se nv bv spa srl oy ab ohg gbr ug ev kgaa"
TRADES = {
    "engineering": "eng", "systems": "sys", "robotics": "rob", "technologies": "tech", "automotive": "auto", "freight": "frt", "foods": "fds", "distribution": "distr",
    "manufacturing": "mfg", "warehousing": "whsg", "international": "intl", "pharma": "pharm", "logistik": "log logist logistics", "maschinenbau": "maschbau masch bau", "cold": "cc coldchain", "chain": "",
}
TITLES = "hr herr frau mr mrs ms dr prof ing dipl jr sr"
PLACES = "yard park"

_BRACKETS = re.compile(r"[(（][^)）]*[)）]?")
_PIECE = re.compile(r"[^\W_]+(?:\.[^\W_]+)*\.?")
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")
_MODEL = re.compile(r"[a-z]{0,2}\d+|\d.*")
_LIKE = str.maketrans({"0": "o", "1": "l", "5": "s", "y": "i", "j": "i", "v": "w", "c": "k"})
_DIGIT_LETTERS = str.maketrans("015", "ols")
_TWICE = re.compile(r"(.)\1+")
_VOWELS = re.compile("[aeiou]")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of a row in one integer."""
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        m = row & where.get(ch, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def plain(text: str) -> str:
    text = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    return text.casefold()


def folded(word: str) -> str:
    """A core word without the differences that spelling by ear and by hand makes."""
    for a, b in (("ph", "f"), ("oo", "u"), ("ck", "k"), ("ts", "z"), ("ou", "u")):
        word = word.replace(a, b)
    return _TWICE.sub(r"\1", word.translate(_LIKE))


class Words:
    """The word lists that names are read with. None is needed: a name without listed words is all core."""

    def __init__(self, nicknames: dict[str, str] = NICKNAMES, legal: str = LEGAL, trades: dict[str, str] = TRADES, titles: str = TITLES, places: str = PLACES):
        self.legal, self.titles, self.places = set(legal.split()), set(titles.split()), set(places.split())
        self.trade_of = {short: full for full, shorts in trades.items() for short in [full, *shorts.split()]}
        self.first_of: dict[str, set[str]] = {}
        for full, shorts in nicknames.items():
            for x in [full, *shorts.split()]:
                self.first_of.setdefault(x, set()).add(full)
        # long words are known although they are misspelt
        self.long = [("trade", w) for w in trades] + [("first", w) for w in nicknames] + [("legal", w) for w in sorted(self.legal) if len(w) > 6]
        self.bags = np.array([_bag(w) for _, w in self.long], np.int8).reshape(-1, 32)
        self.sizes = np.array([len(w) for _, w in self.long], np.int64)
        self.known: dict[str, tuple[str, str]] = {}

    def role(self, word: str) -> tuple[str, str]:
        """What a plain word is: legal, title, place, code, first (with its names), trade, initial or core."""
        role = self.known.get(word)
        if role is None:
            if len(self.known) > 200_000:
                self.known.clear()
            role = self.known[word] = self._role(word)
        return role

    def _role(self, word: str) -> tuple[str, str]:
        # a zero or one among letters is a letter
        read = word.translate(_DIGIT_LETTERS) if sum(map(str.isalpha, word)) > 1 else word
        if read in self.legal or read in self.trade_of or read in self.first_of or read in self.titles:
            word = read
        if word in self.legal:
            return "legal", ""
        if word in self.titles:
            return "title", ""
        if word in self.places:
            return "place", word
        if _MODEL.fullmatch(word):
            return "code", word
        if word in self.trade_of:
            return "trade", self.trade_of[word]
        if word in self.first_of:
            return "first", word
        if len(word) == 1 and word.isascii():
            return "initial", word
        like = word.replace("0", "o").replace("1", "l")
        return self._misspelt(like) or ("core", word)

    def _misspelt(self, like: str) -> tuple[str, str] | None:
        if len(like) < 4:
            return None
        least, best = 0.8 if len(like) > 4 else 0.86, (0.0, "", "")
        bag = np.array(_bag(like), np.int8)
        # letters in common bound the common subsequence
        common = np.minimum(self.bags, bag).sum(1)
        for k in np.flatnonzero(2 * common >= least * (self.sizes + len(like))).tolist():
            kind, w = self.long[k]
            near = 1.0 if common[k] == len(like) == len(w) and like[0] == w[0] else ratio(like, w)
            best = max(best, (near, kind, w))
        return (best[1], best[2] if best[1] != "legal" else "") if best[0] >= least else None

    def same_first(self, a: str, b: str) -> bool:
        if not a or not b or a == b:
            return True
        full = lambda x: self.first_of.get(x, {x})
        if len(a) == 1 or len(b) == 1:
            return any(x[0] == y[0] for x in full(a) | {a} for y in full(b) | {b})
        return bool(full(a) & full(b)) or ratio(a, b) >= 0.8


def _bag(word: str) -> list[int]:
    """How often each letter stands in a word, 31 letters and all others."""
    out = [0] * 32
    for ch in word:
        k = ord(ch) - 96 if "a" <= ch <= "z" else 0
        out[k] = min(127, out[k] + 1)
    return out


def parse(name: str, words: Words) -> dict | None:
    """core (folded words), first (plain, may be an initial), trade, codes (what has to agree exactly); None if blank.

    Codes are words with figures, and words of places: a model or a site is told apart by them. A name
    of codes alone has them as its core. A name of nothing but first names, forms and titles, or without
    letters, is its own code: it agrees with equal names only.
    """
    text = _BRACKETS.sub(" ", unicodedata.normalize("NFKC", name))
    core, codes, first, initial, trade, company = [], [], "", "", "", False
    for piece in _PIECE.findall(text.replace("&", " ")):
        parts = [piece.replace(".", "")]
        if "." not in piece and not piece.isupper() and words.role(plain(piece))[0] == "core":
            # two words in one; a legal form of mixed case is one word
            parts = _CAMEL.split(piece)
        for part in parts:
            word = plain(part)
            role, value = words.role(word)
            if role in ("place", "code"):
                codes.append(value)
            elif role == "legal":
                company = True
            elif role == "trade":
                # cold chain is one trade in two words
                trade = trade or ("cold" if value == "chain" else value)
                company = True
            elif role == "first" and not first:
                first = value
            elif role == "initial":
                initial = value
            elif role == "core":
                core.append(folded(word))
    if not core:
        if not codes:
            whole = " ".join(plain(unicodedata.normalize("NFKC", name)).split())
            return {"core": [whole.replace(" ", "")], "first": "", "trade": "", "codes": "="} if whole else None
        core = [folded(c) for c in codes]
    if company:
        first = initial = ""
    return {"core": core, "first": first or initial, "trade": trade, "codes": " ".join(sorted(codes))}


def blocks(core: list[str]) -> list[tuple[str, str, str]]:
    """(block, letter before it, consonants of the rest) of a core.

    Two names that share a suffix share the shorter ones too: the letter before tells where they part.
    """
    out: dict[str, tuple[str, str]] = {}
    bones = [_VOWELS.sub("", w) for w in core]
    for k, w in enumerate(core):
        rest = "".join(bones[:k] + bones[k + 1 :]) or bones[k]
        for a in range(max(1, len(w) - SUFFIX + 1)):
            out.setdefault("w" + w[a:], (w[a - 1] if a else "", rest))
        if len(core) > 1 and len(bones[k]) > 2:
            out.setdefault("b" + bones[k], ("", rest))
    for order in {tuple(bones), tuple(reversed(bones))}:
        whole = _TWICE.sub(r"\1", "".join(order))
        for a in range(max(1, len(whole) - SKELETON + 1)):
            out.setdefault("s" + whole[a:], ("", "".join(sorted(whole[: max(a, 2)]))))
    return [(block, *x) for block, x in out.items()]


def same_name(a: tuple, b: tuple, least: float, least_word: float, words: Words) -> bool:
    """Whether two parsed names (core, first, trade, codes) mean the same."""
    return bool(same_names([(a, b)], least, least_word, words)[0])


def _letters(words: list[str], width: int) -> np.ndarray:
    joined = "".join(w.ljust(width, "\0") for w in words)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """ratio() of many pairs at once: each row of the bit-parallel recurrence is one step for all pairs."""
    out = np.zeros(len(a))
    sizes = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    for k in np.flatnonzero(sizes > 62).tolist():
        out[k] = ratio(a[k], b[k])
    for low, width in ((0, 8), (8, 16), (16, 32), (32, 62)):
        at = np.flatnonzero((sizes > low) & (sizes <= width))
        if not len(at):
            continue
        left, right = [a[k] for k in at], [b[k] for k in at]
        na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
        x, y = _letters(left, width), _letters(right, width)
        powers = np.uint64(1) << np.arange(width, dtype=np.uint64)
        full = (np.uint64(1) << na.astype(np.uint64)) - np.uint64(1)
        row = full.copy()
        for j in range(int(nb.max())):
            m = ((x == y[:, j, None]) * powers).sum(1, dtype=np.uint64)
            m &= row
            row = np.where(j < nb, ((row + m) | (row - m)) & full, row)
        left_over = (((row[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).sum(1)).astype(np.int64)
        out[at] = 2 * (na - left_over) / (na + nb)
    return out


def same_names(pairs: list[tuple[tuple, tuple]], least: float, least_word: float, words: Words) -> np.ndarray:
    """same_name of many pairs.

    Words of two names of two words each must be alike one by one, short ones more so. Cores of
    fewer than five letters must be equal.
    """
    n = len(pairs)
    agree = [not (fa and tb or fb and ta or ta and tb and ta != tb) and xa == xb and (xa != "=" or ca == cb) and words.same_first(fa, fb) for (ca, fa, ta, xa), (cb, fb, tb, xb) in pairs]
    at = np.flatnonzero(np.array(agree, bool))
    cores = [(pairs[k][0][0], pairs[k][1][0]) for k in at]
    out = np.zeros(n, bool)
    if not len(at):
        return out
    two = np.array([len(ca) == len(cb) == 2 for ca, cb in cores], bool)
    swaps = np.array([len(ca) == 2 or len(cb) == 2 for ca, cb in cores], bool)
    one, other = ["".join(ca) for ca, _ in cores], ["".join(cb) for _, cb in cores]
    turned = [(ca[1] + ca[0], "".join(cb)) if len(ca) == 2 else ("".join(ca), cb[1] + cb[0]) if len(cb) == 2 else ("", "") for ca, cb in cores]

    def alike(mask: np.ndarray, turn: bool) -> np.ndarray:
        """Whether the words of pairs of two words each agree."""
        ok = np.ones(len(cores), bool)
        k = np.flatnonzero(mask & two)
        for i in (0, 1):
            left, right = [cores[j][0][i] for j in k], [cores[j][1][1 - i if turn else i] for j in k]
            short = np.array([min(len(x), len(y)) < 5 for x, y in zip(left, right)], bool)
            ok[k] &= ratios(left, right) >= np.where(short, np.maximum(least_word, 0.8), least_word)
        return ok

    small = np.array([min(len(x), len(y)) < 5 for x, y in zip(one, other)], bool)
    straight = ratios(one, other) >= np.where(small, 1.0, least)
    straight &= alike(straight, False)
    rest = swaps & ~straight
    crossed = np.zeros(len(cores), bool)
    k = np.flatnonzero(rest)
    crossed[k] = ratios([turned[j][0] for j in k], [turned[j][1] for j in k]) >= np.where(small[k], 1.0, least)
    crossed &= alike(crossed, True)
    out[at] = straight | crossed
    return out


FORM = ("core", "first", "trade", "codes")
PARSED = T.StructType([T.StructField(c, T.StringType()) for c in ("space", "name", *FORM)])


def _parse_all(batches: Iterator[pd.DataFrame], words: Words) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for space, name in zip(pdf["space"], pdf["name"]):
            p = parse(name, words)
            if p:
                rows.append((space, name, " ".join(p["core"]), p["first"], p["trade"], p["codes"]))
        yield pd.DataFrame(rows, columns=PARSED.names)


INDEXED = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("within", T.StringType()), T.StructField("block", T.StringType()), T.StructField("before", T.StringType()), T.StructField("rest", T.StringType()),
    T.StructField("trade", T.IntegerType()), T.StructField("has_first", T.BooleanType()), T.StructField("size", T.ShortType()),
])


def _index_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for node, within, core, trade, has_first, size in pdf[["node", "within", "core", "trade", "has_first", "size"]].itertuples(index=False):
            rows += [(node, within, *x, trade, has_first, size) for x in blocks(core.split(" "))]
        yield pd.DataFrame(rows, columns=INDEXED.names)


def flavour(first: str, trade: str) -> str:
    """What tells names with one core apart: the trade, or that it is a person's; empty if the name doesn't say."""
    return trade or (first and "person")


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("flavour_a", T.StringType()), T.StructField("flavour_b", T.StringType())])


def _compare_all(batches: Iterator[pd.DataFrame], least: float, least_word: float, words: Words) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sides = [list(zip(map(str.split, pdf["core" + x]), pdf["first" + x], pdf["trade" + x], pdf["codes" + x])) for x in ("", "2")]
        same = same_names(list(zip(*sides)), least, least_word, words)
        rows = [(a, b, flavour(x[1], x[2]), flavour(y[1], y[2])) for a, b, x, y, ok in zip(pdf["a"], pdf["b"], *sides, same.tolist()) if ok]
        yield pd.DataFrame(rows, columns=LINK.names)


def without_contradictions(links: DataFrame) -> DataFrame:
    """Links a, b: a name that tells neither trade nor person stays with the trade that most of its links have.

    Otherwise it would join organisations of one name and different trades.
    """
    told = links.where("flavour_a = '' and flavour_b <> ''").select(F.col("a").alias("bare"), F.col("flavour_b").alias("flavour"))
    told = told.unionByName(links.where("flavour_b = '' and flavour_a <> ''").select(F.col("b").alias("bare"), F.col("flavour_a").alias("flavour")))
    count = told.groupBy("bare", "flavour").agg(F.count("*").alias("n"))
    own = count.groupBy("bare").agg(F.max_by("flavour", F.struct("n", "flavour")).alias("own"))
    side = lambda c: own.select(F.col("bare").alias(c), F.col("own").alias("own_" + c))
    both = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    left, right = (F.when(F.col(f"flavour_{c}") != "", F.col(f"flavour_{c}")).otherwise(F.col(f"own_{c}")) for c in "ab")
    return both.where(left.isNull() | right.isNull() | (left == right)).select("a", "b")


def connected(spark, links: DataFrame, most_rounds: int = 30) -> DataFrame:
    """node, root (the least node of its class) from links (a, b), by large-star and small-star.

    Each round ends in stars or goes on: once no centre has a centre of its own, the classes are there.
    """
    use_shared_checkpoints(spark)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a star's centre has no lesser neighbour, its other nodes have one neighbour
        ends = both.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w"))
        if ends.where("v < u and v <> w").isEmpty():
            break
        own = Window.partitionBy("u")
        large = both.withColumn("m", F.least(F.min("v").over(own), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", F.min("v").over(own)).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = small.where("u <> v").distinct().checkpoint()
    else:
        raise RuntimeError("classes did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def candidate_pairs(forms: DataFrame, common: int = COMMON, least: float = 0.0) -> DataFrame:
    """a < b: nodes of forms (node, space, core, first, trade, codes) that share a block and may be alike.

    A block of more than `common` forms is refined with two consonants of the rest of the core, at its start
    and at its end; one that still has DEEPER times as many with four, and so on, up to LEVELS times. What stays large then differs in hardly more than vowels:
    its pairs are compared as they are, by a join that Spark splits.
    """
    use_shared_checkpoints(forms.sparkSession)
    size = F.length(F.replace("core", F.lit(" "), F.lit(""))).cast("short").alias("size")
    # no trade is 0
    trade = F.when(F.col("trade") != "", F.hash("trade")).otherwise(0).alias("trade")
    index = forms.select("node", F.concat_ws("\x1f", "space", "codes").alias("within"), "core", trade, (F.col("first") != "").alias("has_first"), size).mapInPandas(_index_all, INDEXED)
    # blocks as hashes: a collision only adds a pair to compare
    index = index.withColumn("block", F.xxhash64("within", "block")).drop("within").withColumn("side", F.lit("")).withColumn("key", F.col("block")).checkpoint()
    done = None
    for level in range(1, LEVELS + 1):
        most = common if level == 1 else DEEPER * common
        large = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key").checkpoint()
        n = large.count()
        if n == 0:
            break
        large = F.broadcast(large) if n <= MOST_LARGE else large
        small = index.join(large, "key", "left_anti").drop("rest", "side", "block")
        done = small if done is None else done.unionByName(small)
        # the start and the end go their own ways from the first level on
        sides = F.when(F.col("side") == "", F.array(F.lit("<"), F.lit(">"))).otherwise(F.array("side"))
        index = index.join(large, "key", "left_semi").withColumn("side", F.explode(sides))
        part = F.when(F.col("side") == "<", F.substring("rest", 1, 2 * level)).otherwise(F.expr(f"right(rest, {2 * level})"))
        # cut off: else the plan repeats every level before
        index = index.withColumn("key", F.xxhash64("block", "side", part)).checkpoint()
    index = index.drop("rest", "side", "block")
    index = index if done is None else done.unionByName(index)
    other = index.select("key", *[F.col(c).alias(c + "2") for c in index.columns if c != "key"])
    met = index.join(other, "key").where("node < node2")
    # a longer suffix in common has its own block
    met = met.where("before = '' or before <> before2")
    met = met.where("not (trade <> 0 and trade2 <> 0 and trade <> trade2) and not (has_first and trade2 <> 0) and not (trade <> 0 and has_first2)")
    met = met.where(2 * F.least("size", "size2") >= least * (F.col("size") + F.col("size2")))
    return met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def _may_be_alike(least: float) -> Column:
    """Edits bound the common subsequence: pairs of core and core2 that can't reach `least` in either order of words."""
    solid = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    turned = lambda c: F.when(F.size(F.split(c, " ")) == 2, F.concat(F.element_at(F.split(c, " "), 2), F.element_at(F.split(c, " "), 1))).otherwise(solid(c))
    most = (1 - least) * (F.length(solid(F.col("core"))) + F.length(solid(F.col("core2")))) + 1e-9
    near = lambda a, b: F.levenshtein(a, b) <= most
    return near(solid(F.col("core")), solid(F.col("core2"))) | near(turned(F.col("core")), solid(F.col("core2"))) | near(solid(F.col("core")), turned(F.col("core2")))


def link_names(names: DataFrame, common: int = COMMON, least: float = 0.82, least_word: float = 0.7, words: Words | None = None) -> DataFrame:
    """space, name, class_id: equal class ids mean the same person or organisation.

    names: space, name. Names of different spaces are never linked.
    """
    spark = names.sparkSession
    use_shared_checkpoints(spark)
    words = words or Words()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = names.select("space", "name").where("name is not null").distinct()
    # a told number of tasks: names are few bytes and much work
    parsed = distinct.repartition(tasks).mapInPandas(lambda batches: _parse_all(batches, words), PARSED).checkpoint()
    forms = parsed.select("space", *FORM).distinct().withColumn("node", F.monotonically_increasing_id()).checkpoint()
    pairs = candidate_pairs(forms.repartition(tasks), common, least)
    left, right = forms.withColumnRenamed("node", "a").drop("space"), forms.select(F.col("node").alias("b"), *[F.col(c).alias(c + "2") for c in FORM])
    pairs = pairs.join(left, "a").join(right, "b").where(_may_be_alike(least)).repartition(tasks)
    links = pairs.mapInPandas(lambda batches: _compare_all(batches, least, least_word, words), LINK).checkpoint()
    classes = connected(spark, without_contradictions(links))
    rooted = forms.join(classes, "node", "left").withColumn("class_id", F.coalesce("root", "node"))
    return parsed.join(rooted.drop("node", "root"), ["space", *FORM]).select("space", "name", "class_id")


def name_pairs(customers: DataFrame, entities: DataFrame, mentions: DataFrame, **settings) -> DataFrame:
    """pair_kind, left_id, right_id of the records that mean the same person or organisation.

    customers: id, name. entities: entity_no, name, type. mentions: mention_id, entity_id, surface.
    """
    customers = customers.select(F.lit("customer").alias("space"), F.lit("customer").alias("kind"), F.col("id").alias("record"), "name")
    entities = entities.where(F.col("type").isin("COMPANY", "PERSON")).select(F.lit("entity").alias("space"), F.lit("entity").alias("kind"), F.col("entity_no").alias("record"), "name")
    mentions = mentions.where("entity_id is null").select(F.lit("entity").alias("space"), F.lit("mention").alias("kind"), F.col("mention_id").alias("record"), F.col("surface").alias("name"))
    records = customers.unionByName(entities).unionByName(mentions).where("record is not null and name is not null").distinct()
    classes = link_names(records, **settings)
    # read four times below: kept, so that the plan has it once
    member = records.join(classes, ["space", "name"]).select("kind", "record", "class_id").distinct().checkpoint()
    same = member.where("kind <> 'mention'")
    right = same.select(F.col("kind").alias("kind2"), F.col("record").alias("right_id"), "class_id")
    pairs = same.join(right, "class_id").where("kind = kind2 and record < right_id").select(F.col("kind").alias("pair_kind"), F.col("record").alias("left_id"), "right_id")
    said = member.where("kind = 'mention'").select(F.col("record").alias("right_id"), "class_id")
    named = member.where("kind = 'entity'").join(said, "class_id").select(F.lit("mention").alias("pair_kind"), F.col("record").alias("left_id"), "right_id")
    return pairs.unionByName(named).distinct()
