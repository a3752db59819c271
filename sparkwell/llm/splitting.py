"""Splitting of items longer than a limit at natural boundaries.

Recursive bisection: a stretch longer than the limit minus the overlap is cut at
the strongest boundary in the middle half of it (headings, then blank lines, line
breaks, sentence ends, clause marks, white space), at equal strength the one
nearest to its midpoint, and both halves are treated alike. Then each piece but the
first is extended backwards by at most the overlap, to a natural boundary again.
Without any boundary a stretch is cut at its midpoint, yet not before a combining
mark, within a flag or a joined sign if that can be helped.

Defined results: an item within the limit is one piece; null and empty items give
none. Pieces without their overlaps, joined, are the text exactly. The heading of a
piece is the last Markdown heading at or before its own first line, else the item's
own heading, else null. Repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .sentences import sentence_ends

LIMIT, OVERLAP = 900, 150
HEADING, BLANK, LINE, SENTENCE, CLAUSE, SPACE, NONE, INSIDE = 7, 6, 5, 4, 3, 2, 1, 0

_HEADING = re.compile(r"^#{1,6}[ \t]+(.*)$", re.M)
_BLANK = re.compile(r"\n[ \t]*\n\s*")
_CLAUSE = re.compile(r"[,;:，；：、،؛]\s*")
_SPACE = re.compile(r"\s+")
#: Two letters of a flag; what is joined to the sign before it.
_TOGETHER = re.compile(r"[\U0001f1e6-\U0001f1ff](?=[\U0001f1e6-\U0001f1ff])|\u200d(?=.)", re.S)
_COMBINING = re.compile(r"[̀-ًͯ-ٰٟ‍︀-️\U0001f3fb-\U0001f3ff]")


def boundary_strengths(text: str, ends: np.ndarray) -> np.ndarray:
    """strength[i]: how naturally the text can be cut before code point i."""
    at = np.full(len(text) + 1, NONE, np.uint8)
    at[[m.start() for m in _COMBINING.finditer(text)]] = INSIDE
    flag = -1
    for m in _TOGETHER.finditer(text):
        # the second letter of a flag isn't the first one of another
        if m.group() == "\u200d" or m.start() != flag:
            at[m.end()], flag = INSIDE, m.end()
    at[[m.end() for m in _SPACE.finditer(text)]] = SPACE
    at[[m.end() for m in _CLAUSE.finditer(text)]] = CLAUSE
    for e in ends.tolist():
        m = _SPACE.match(text, e)
        at[m.end() if m else e] = SENTENCE
    line = text.find("\n")
    while line >= 0:
        at[line + 1] = max(at[line + 1], LINE)
        line = text.find("\n", line + 1)
    at[[m.end() for m in _BLANK.finditer(text)]] = BLANK
    at[[m.start() for m in _HEADING.finditer(text)]] = HEADING
    return at


def bisect(strength: np.ndarray, n: int, most: int) -> list[int]:
    """Starts of the stretches, each of at most `most` code points."""
    starts, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            starts.append(a)
            continue
        quarter, middle = (b - a) // 4, (a + b) // 2
        lo, hi = max(a + 1, a + quarter), b - quarter
        part = strength[lo : hi + 1]
        best = np.flatnonzero(part == part.max())
        cut = lo + int(best[np.abs(best + lo - middle).argmin()])
        todo += [(cut, b), (a, cut)]
    return starts


def pieces(text: str, ends: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(begin, own start, end) of each piece; begin < own start where it repeats its neighbour's end."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n)] if n else []
    strength = boundary_strengths(text, ends)
    starts = bisect(strength, n, limit - overlap)
    out = []
    for k, a in enumerate(starts):
        b = starts[k + 1] if k + 1 < len(starts) else n
        begin = a
        if k and overlap:
            before = strength[a - overlap if a > overlap else 0 : a]
            for least in (SENTENCE, SPACE, NONE):
                natural = np.flatnonzero(before >= least)
                # a sentence that starts only just before the cut is too little to share
                if len(natural) and (least < SENTENCE or len(before) - natural[0] >= overlap // 4):
                    begin = a - len(before) + int(natural[0])
                    break
        out.append((begin, a, b))
    return out


PIECES = T.StructType([
    T.StructField("item_table", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("position", T.IntegerType()),
    T.StructField("heading", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("overlap_chars", T.IntegerType()), T.StructField("n_chars", T.IntegerType()),
])


def _pieces_of(batches: Iterator[pd.DataFrame], limit: int, overlap: int, with_text: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        texts = pdf["text"].tolist()
        long = [k for k, t in enumerate(texts) if len(t) > limit]
        ends = dict(zip(long, sentence_ends([texts[k] for k in long])))
        for k, (table, item, own, text) in enumerate(zip(pdf["item_table"], pdf["item_id"], pdf["heading"], texts)):
            heads = [(m.start(), m.group(1).strip()) for m in _HEADING.finditer(text)]
            h, heading = 0, own or None
            for position, (begin, start, end) in enumerate(pieces(text, ends.get(k), limit, overlap)):
                while h < len(heads) and heads[h][0] <= start:
                    heading, h = heads[h][1], h + 1
                rows.append((table, item, position, heading, begin, start - begin, end - begin, *([text[begin:end]] if with_text else [])))
        yield pd.DataFrame(rows, columns=[f.name for f in PIECES.fields] + (["text"] if with_text else []))


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of `items` (item_table, item_id, heading, text)."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    schema = T.StructType(PIECES.fields + ([T.StructField("text", T.StringType())] if with_text else []))
    items = items.select("item_table", "item_id", "heading", "text").where(F.col("text").isNotNull())
    return spread(items).mapInPandas(lambda batches: _pieces_of(batches, limit, overlap, with_text), schema)
