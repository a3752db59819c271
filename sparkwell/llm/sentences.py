"""Sentence boundaries in texts of several languages and scripts.

The boundary rules are compiled into a finite transducer: a table that maps
(state, symbol) to (next state, emit). Symbols are classes of code points; a dot
gets its class from the word before it and the start of the word after it
(abbreviation, ordinal, decimal, ellipsis or full stop). All texts of a batch
stand in one array, cut into blocks of equal length. Each block becomes a function
from states to states; a parallel prefix scan composes these functions, which
gives the state at the start of every block, and a second pass over all blocks at
once emits the boundaries. A line break, and the end of a text, take every state
to the start.

Defined results: null, empty and blank texts have no sentence. Every code point
that isn't white space belongs to exactly one sentence, in order, whatever the
length of the text. Repeated rows give repeated results before distinct().
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

BLOCK = 64
SLICE = 1 << 18

# ---- symbols
NL, SP, OQ, CQ, OB, CB, HARD, FULL, WEAK, ELL, COLON, LOW, UP, CJK, ARAB, DIGIT, COMMA, OTHER = range(18)
SYMBOLS = 18
# ---- states; *S: after white space
START, BODY, SAID, Q, QT, K, KT, P, PT, B0, B0T, TH, THS, TF, TFS, TW, TWS, TE, TES, TQ, TQS, TK, TKS = range(23)
STATES = 23

# Abbreviations, without their last dot, in lower case.
NEVER_END = set(
    "mr mrs ms dr prof hr hrn fr st nr no fig sect sec. approx vs cf vgl bzw abb abschn ca ggf inkl exkl max min tel evtl bspw sog z.b d.h u.a i.e e.g al vol ch p pp art eq ref ft dept bd kap str hrsg ing dipl z d u i".split()
) | {"per sec"}
MAY_END = set("etc usw u.s.w a.m p.m am pm jr sr u.k u.s u.s.a e.u".split())
LEGAL = set("inc ltd co corp s.a a.g g.m.b.h l.l.c plc soc cie s.p.a b.v n.v s.a.r.l".split())
TRADE = set("eng sys rob tech auto frt fds distr mfg whsg intl pharm logist log masch ind manuf int warehsg cc wh".split())
AFTER_NAME = re.compile(r"(?:&|\(|(?:und|and|co|kg|sa|ag|gmbh|mbh|inc|ltd)(?![a-z])|k\.g|s\.a|a\.g|g\.m\.b\.h|limited|soc|anonyme|gesellschaft|aktiengesellschaft|incorporated|corp)", re.I)
# Words that carry a sentence on after a name that ends in an abbreviation, in scripts without case.
CARRY_ON = set("تورد في كل يتوافق هي من على إلى و لجهاز لـ نے ہر کا کو معیار کی کے میں سے پر ہے اور تک".split())
MONTHS = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert)\b")
BEFORE_ORDINAL = set("am vom zum im beim die der das dem den des seit bis ab jede jeder jedes jeden jedem ins ans".split())

_CLOSERS = ")]}»”’\"'」』）】〉》›‘“"
_QUOTED = re.compile(r"„[^„“”\n]*[“”]|“[^“”\n]*”|«[^«»\n]*»|’’[^’‘\n]*‘‘|‘‘[^’‘\n]*’’|「[^「」\n]*」|『[^『』\n]*』|(?<![^\s(\[（:：،,。！？])\"[^\"\n]+\"|(?<=[:：一-鿿])\"[^\"\n]+\"")
_BRACKETED = re.compile(r"\([^()\n]*\)|（[^（）\n]*）|\[[^\[\]\n]*\]|【[^【】\n]*】")
# Dots that need their word looked at; any other follows a word too long for an abbreviation.
_DOT = re.compile(r"\.(?!\.)(?:(?<![a-zäöüß]{5}\.)(?<![\u0620-\u06ff]{3}\.)|(?<=pharm\.|masch\.|ogist\.|pprox\.|bschn\.|distr\.))(?<!\.\.)")
_NEXT = re.compile(r"[^\S\n]*(\S*)")
_NO_SPACE = re.compile(r"[A-ZÄÖÜ][a-zäöüß]|[A-ZÄÖÜ] ")


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    t = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x3000):
        ch, kind = chr(c), unicodedata.category(chr(c))
        if ch.isspace():
            t[c] = SP
        elif 0x600 <= c < 0x780 and kind[0] in "LM":
            t[c] = ARAB
        elif kind in ("Lu", "Lt"):
            t[c] = UP
        elif kind[0] in "LM":
            t[c] = LOW
        elif kind[0] == "N":
            t[c] = DIGIT
    t[0x750:0x780] = t[0x8A0:0x900] = t[0xFB50:0xFE00] = t[0xFE70:0xFEFF] = ARAB
    t[0x3005:0x3008] = t[0x3040:0xA000] = t[0xAC00:0xD7B0] = t[0xF900:0xFB00] = t[0x20000:0x40000] = CJK
    t[0xFF21:0xFF3B], t[0xFF41:0xFF5B], t[0xFF10:0xFF1A] = UP, LOW, DIGIT
    t[0x3000] = SP
    for ch in "\n\r\v\f\x1c\x1d\x1e\x85  ":
        t[ord(ch)] = NL
    for ch in _CLOSERS:
        t[ord(ch)] = CQ
    for ch in "!?。！？؟۔｡‼⁇⁈⁉":
        t[ord(ch)] = HARD
    t[ord("…")] = ELL
    t[ord(".")] = FULL
    for ch in ":：﹕":
        t[ord(ch)] = COLON
    for ch in ",;،؛，；、–—":
        t[ord(ch)] = COMMA
    return t


@lru_cache(maxsize=1)
def _mark_table() -> np.ndarray:
    t = np.zeros(0x10000, np.uint8)
    for ch in "([（【":
        t[ord(ch)] = 1
    for ch in "„“«’‘「『\"":
        t[ord(ch)] = 2
    return t


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emit) by state * SYMBOLS + symbol; emit: a sentence ended before this symbol."""
    to, out = np.full((STATES, SYMBOLS), BODY, np.uint8), np.zeros((STATES, SYMBOLS), bool)
    opens = {OQ: Q, OB: B0, HARD: TH, FULL: TF, WEAK: TW, ELL: TE, COLON: SAID, SP: START}
    for symbol, state in opens.items():
        to[START, symbol] = state
    to[START, CB] = to[START, CQ] = BODY
    body = {OQ: Q, OB: P, HARD: TH, FULL: TF, WEAK: TW, ELL: TE, COLON: SAID}
    for symbol, state in body.items():
        to[BODY, symbol] = to[SAID, symbol] = state
    to[SAID, SP], to[SAID, OQ] = SAID, K
    # inside quotes and brackets nothing ends; *T remembers a stop just before the closing mark
    stops = (HARD, FULL, WEAK, ELL)
    for plain, stopped, close, after, weak in ((Q, QT, CQ, TQ, BODY), (K, KT, CQ, TK, BODY), (P, PT, CB, BODY, BODY), (B0, B0T, CB, TK, BODY)):
        to[plain, :] = to[stopped, :] = plain
        to[plain, stops] = to[stopped, stops] = stopped
        to[stopped, SP] = stopped
        to[stopped, CQ if close == CB else CB] = stopped
        to[plain, close], to[stopped, close] = weak, after
    # pending: a stop, then closers, then white space; what follows decides
    for wait, spaced in ((TH, THS), (TF, TFS), (TW, TWS), (TE, TES), (TQ, TQS), (TK, TKS)):
        to[wait, SP], to[spaced, SP] = spaced, spaced
        to[wait, [CQ, CB]] = TQ if wait == TH else wait
        for symbol, state in ((HARD, TH), (FULL, TF), (WEAK, TW), (ELL, TE)):
            to[wait, symbol] = state
            to[spaced, symbol] = state

        def end(state: int, *symbols: int) -> None:
            for x in symbols:
                out[state, x], to[state, x] = True, to[START, x]

        if wait in (TH, TF, TK):
            end(spaced, LOW, UP, CJK, ARAB, DIGIT, OQ, OB, OTHER, COLON, CQ, CB)
        elif wait == TW:
            end(spaced, UP, CJK, ARAB, DIGIT, OQ, OB, OTHER)
        elif wait == TE:
            end(spaced, UP, OQ, OB)
        elif wait == TQ:
            end(spaced, UP, DIGIT, OQ, OB, OTHER)
        if wait in (TH, TK):
            end(wait, UP, CJK, ARAB, DIGIT, OQ, OB)
        if wait == TF:
            end(wait, UP, CJK, OQ, OB)
        if wait == TQ:
            end(wait, OQ, OB, UP)
    to[:, NL], out[:, NL] = START, True
    out[START, NL] = False
    return to.ravel(), out.ravel()


@lru_cache(maxsize=1)
def _pairs() -> np.ndarray:
    to = transducer()[0].reshape(STATES, SYMBOLS).astype(np.intp)
    return np.ascontiguousarray(to[to].reshape(STATES, -1) * SYMBOLS * SYMBOLS).ravel()


def _dot_symbol(text: str, at: int, end: int) -> int:
    """The symbol of the single dot at `at`; text[at + 1:] goes on."""
    nxt = text[end] if end < len(text) else "\n"
    begin = at
    low = max(0, at - 24)
    while begin > low and not text[begin - 1].isspace() and text[begin - 1] not in "([（„“\"«":
        begin -= 1
    word = text[begin:at]
    spaced = nxt.isspace() or nxt in _CLOSERS
    small = word.lower()
    if not spaced:
        if word[-2:].isalpha() and word[-2:].islower() and word[-1:] < "ɐ" and small not in NEVER_END and small not in TRADE and "@" not in word and "/" not in word and "." not in word and _NO_SPACE.match(text, end):
            return FULL
        return OTHER
    if not word:
        return WEAK
    if len(small) > 1 and small in NEVER_END:
        return OTHER
    if small in MAY_END:
        return WEAK
    last = small.rsplit("-", 1)[-1]
    parts = small.split(".")
    dotted = len(parts) > 1 and all(len(p) == 1 and p.isalpha() for p in parts[1:]) and len(parts[0]) == 1
    if last in LEGAL or last in TRADE or dotted:
        following = _NEXT.match(text, end).group(1)
        if AFTER_NAME.match(following):
            return OTHER
        if following and "؀" <= following[0] < "ݿ":
            return OTHER if following.strip("،.") in CARRY_ON else WEAK
        before = text[max(0, begin - 24) : begin].rsplit("\n", 1)[-1].split()
        if last in TRADE and (not before or before[-1][:1].islower() or before[-1][-1] in ".!?:"):
            return OTHER
        return WEAK
    if len(word) == 1 and word.isalpha():
        if word.isupper() and text[max(0, begin - 2) : begin].strip() == ",":
            return WEAK
        return OTHER
    if word.isdigit():
        following = _NEXT.match(text, end).group(1)
        before = text[max(0, begin - 24) : begin].rsplit("\n", 1)[-1].split()
        if not before and (begin == 0 or text[begin - 1] == "\n"):
            return OTHER
        if MONTHS.match(following) or before and before[-1].lower() in BEFORE_ORDINAL and following[:1].isalpha():
            return OTHER
        return WEAK
    letters = word.rstrip(_CLOSERS)
    if len(letters) >= 3 and letters.isalpha() and (letters.islower() or letters.isupper() or not letters.lower().isupper() and letters.lower() == letters.upper()):
        return FULL
    return WEAK


def symbols(text: str) -> np.ndarray:
    """One symbol per code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _symbol_table()[points]
    marks = _mark_table()[np.minimum(points, 0xFFFF)]
    for pattern, kind, opening, closing in ((_BRACKETED, 1, OB, CB), (_QUOTED, 2, OQ, CQ)):
        done = 0
        for at in np.flatnonzero(marks == kind).tolist():
            m = pattern.match(text, at) if at >= done else None
            if m is None:
                continue
            a, b = m.span()
            done = b
            found[a], found[b - 1] = opening, closing
            if text[a] in "’‘" and text[a + 1] == text[a]:
                found[a : a + 2], found[b - 2 : b] = (opening, OTHER), (OTHER, closing)
    for m in _DOT.finditer(text):
        found[m.start()] = _dot_symbol(text, m.start(), m.end())
    dots = points == ord(".")
    found[1:][dots[1:] & dots[:-1]] = ELL
    found[:-1][dots[1:] & dots[:-1]] = ELL
    low, up = found == LOW, found == UP
    found[1:-1][low[1:-1] & up[2:] & ~low[:-2] & ~up[:-2]] = UP
    return found


def _run(found: np.ndarray) -> np.ndarray:
    """Positions at which the transducer emits, by block functions and a prefix scan."""
    to, out = transducer()
    n = len(found)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, NL, np.intp)
    padded[:n] = found
    column = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    # two symbols at a step; states come multiplied by the width of the table
    two, width = _pairs(), SYMBOLS * SYMBOLS
    maps = np.tile(np.arange(STATES, dtype=np.intp) * width, (blocks, 1))
    for k in range(0, BLOCK, 2):
        maps = two.take(maps + (column[k] * SYMBOLS + column[k + 1])[:, None])
    maps //= width
    step = 1
    while step < blocks:
        composed = maps.copy()
        composed[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        maps, step = composed, step * 2
    state = np.empty(blocks, np.intp)
    state[0], state[1:] = START, maps[:-1, START]
    emitted = np.empty((BLOCK, blocks), bool)
    for k, symbol in enumerate(column):
        at = state * SYMBOLS + symbol
        emitted[k] = out.take(at)
        state = to.take(at).astype(np.intp)
    return np.flatnonzero(emitted.T.ravel()[:n])


def sentence_ends(texts: list[str]) -> list[np.ndarray]:
    """For each text the code-point ends of its sentences, in order."""
    result: list[np.ndarray] = []
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < SLICE):
            size += len(texts[last]) + 1
            last += 1
        part = texts[first:last]
        joined = "\n".join(part) + "\n"
        found = symbols(joined)
        emits = _run(found)
        solid = np.where((found != SP) & (found != NL), np.arange(len(found)), -1)
        ends = np.maximum.accumulate(solid)[np.maximum(emits - 1, 0)] + 1
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
        cut = np.searchsorted(ends, starts, side="right")
        cut[0] = 0
        for k in range(len(part)):
            result.append(ends[cut[k] : cut[k + 1]] - starts[k])
        first = last
    return result


ENDS = T.StructType([T.StructField("unit_table", T.StringType()), T.StructField("unit_id", T.StringType()), T.StructField("sentence_no", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])


def _ends_of(batches: Iterator[pd.DataFrame], with_text: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ends = sentence_ends(pdf["text"].tolist())
        n = np.array([len(e) for e in ends], np.int64)
        flat = np.concatenate(ends) if len(ends) else np.empty(0, np.int64)
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(len(pdf)), n)
        begin = np.zeros(len(flat), np.int64)
        begin[1:] = flat[:-1]
        begin[first[n > 0]] = 0
        out = {"unit_table": pdf["unit_table"].to_numpy()[row], "unit_id": pdf["unit_id"].to_numpy()[row], "sentence_no": (np.arange(len(flat)) - first[row]).astype(np.int32), "start_char": begin.astype(np.int32), "end_char": flat.astype(np.int32)}
        if with_text:
            texts = pdf["text"].tolist()
            out["sentence"] = [texts[r][a:b].strip() for r, a, b in zip(row, begin, flat)]
        yield pd.DataFrame(out)


def split_sentences(units: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per sentence of `units` (unit_table, unit_id, text).

    start_char is where the sentence before ended; with_text adds the sentence.
    """
    schema = T.StructType(ENDS.fields + ([T.StructField("sentence", T.StringType())] if with_text else []))
    units = units.select("unit_table", "unit_id", "text").where(F.col("text").isNotNull())
    return spread(units).mapInPandas(lambda batches: _ends_of(batches, with_text), schema)
