"""Reading level of each document.

The words of the sentences of all documents are counted per language and ranked by
frequency. The coverage rank of a document is the size of the smallest such
vocabulary, most frequent words first, that covers a fixed share of its words.
The first `vocabulary` ranks of each language are sent to tasks, which bounds what is sent;
documents that need rarer words get their rank from a join with all ranked words. Sentence complexity is the length of sentences and
of words, taken as medians that weigh each sentence by its length, so that fillers,
headings and foreign passages don't move them. Only whole sentences in the language
that most of the document is written in count; lists, headings and codes don't.

The calibration is plain SQL over the rated documents: per language and band the
median and the spread of each measure, both shrunk to those of all languages where a
language has few ratings, and the band that a document is nearest to.

Defined results: documents under `least_chars` code points have no row. A document
without a single sentence is measured by its lines; without words it gets the middle
band. Null ratings don't count, repeated ones do so once. Without any rating, bands
are null. Ties go to the lower band.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lang import ENGLISH_ONLY, GERMAN_ONLY, URDU_ONLY
from ..session import spread, use_shared_checkpoints
from .sentences import sentence_ends

#: Words, Chinese ones by the letter; the letters are written out, which is looked up faster than classes.
_CHINESE = "㐀-䶿一-鿿"
_ANY_WORD = re.compile(rf"[{_CHINESE}]|[^\W\d_{_CHINESE}]+(?:['’-][^\W\d_{_CHINESE}]+)*")
_STOPS, _CLOSERS = tuple(".!?。！？؟۔…"), "\"”»’‘“)）]*_"
_ENGLISH, _GERMAN = set(ENGLISH_ONLY), set(GERMAN_ONLY)
_URDU_WORD = re.compile(f"[{''.join(URDU_ONLY)}][^ ]*")


@lru_cache(maxsize=1)
def _plain_words() -> re.Pattern:
    """_ANY_WORD for texts without code points beyond 0xFFFF."""
    other = re.compile(rf"[\W\d_{_CHINESE}]")
    letters = [c for c in range(0x10000) if not other.match(chr(c))]
    starts = [c for c, before in zip(letters, [-1, *letters]) if c != before + 1]
    ends = [c for c, after in zip(letters, [*letters[1:], -1]) if c != after - 1]
    own = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))
    return re.compile(f"[{_CHINESE}]|[{own}]+(?:['’-][{own}]+)*")


def _words_of(text: str) -> re.Pattern:
    return _plain_words() if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else _ANY_WORD


def _starting(words: list[str], low: str, high: str) -> list[str]:
    """The words whose first letter lies between; that of the least and the greatest word may tell."""
    first, last = min(words)[0], max(words)[0]
    if first > high or last < low:
        return []
    return words if low <= first and last <= high else [w for w in words if low <= w[0] <= high]


def language_of(words: list[str]) -> str:
    """By script, then by frequent words or letters; words in lower case, one at least."""
    n = len(words)
    latin = len(_starting(words, "", "ɏ"))
    if latin < n:
        han, arabic = len(_starting(words, "㐀", "鿿")), _starting(words, "؀", "ۿ")
        few = latin * 2 < n
        if few and han * 2 >= n - latin:
            return "zh"
        # names may outnumber the words of another script around them
        if arabic and (few or len(arabic) * 3 >= n):
            return "ur" if len(_URDU_WORD.findall(" ".join(arabic))) * 4 > len(arabic) else "ar"
        if not few and han * 3 >= n:
            return "zh"
    return "de" if len(_GERMAN.intersection(words)) > len(_ENGLISH.intersection(words)) else "en"


def _own_script(language: str, words: list[str]) -> list[str]:
    if language == "zh":
        return _starting(words, "㐀", "鿿")
    if language in ("ar", "ur"):
        return _starting(words, "؀", "ۿ")
    return words


def _weighted_median(values: list[float], weights: list[int]) -> float:
    """The least value at which half of the weight is reached."""
    half, upto = sum(weights) / 2, 0
    for value, weight in sorted(zip(values, weights)):
        upto += weight
        if upto >= half:
            break
    return value


MEASURES = T.StructType([
    T.StructField("language", T.StringType()), T.StructField("sentence_words", T.DoubleType()), T.StructField("word_chars", T.DoubleType()),
    T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
])


def _with_id(docs: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([docs.schema["doc_id"], *fields])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        words_of, counts_of, sizes = [], [], [0]
        texts = batch.column("text").to_pylist()
        for text, ends in zip(texts, sentence_ends(texts)):
            pattern, units, lines, start = _words_of(text), [], [], 0
            for end in ends.tolist():
                s = text[start:end]
                start = end
                words = pattern.findall(s.lower())
                if words:
                    (units if s.rstrip(_CLOSERS).endswith(_STOPS) else lines).append(words)
            size: Counter = Counter()
            told = [(language_of(words), words) for words in units or lines]
            for language, words in told:
                size[language] += len("".join(words))
            if not size:
                rows.append((None, None, None))
                sizes.append(sizes[-1])
                continue
            language = max(size, key=lambda x: (size[x], x))
            own = [w for w in (_own_script(language, words) for x, words in told if x == language) if w]
            n = [len(w) for w in own]
            chars = [len("".join(words)) / k for words, k in zip(own, n)]
            bag = Counter(chain.from_iterable(own))
            rows.append((language, float(_weighted_median(n, n)), _weighted_median(chars, n)))
            words_of += bag
            counts_of += bag.values()
            sizes.append(len(words_of))
        at = pa.array(sizes, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(words_of, pa.string())), pa.ListArray.from_arrays(at, pa.array(counts_of, pa.int32()))]
        told = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *told, *lists], ["doc_id", *MEASURES.names])


def _ranked(word: DataFrame) -> DataFrame:
    """language, word, rank: all words, numbered within ranges of the sorted whole instead of in one window a language."""
    order = [F.col("language"), F.desc("n"), F.col("word")]
    # where the ranges end is found by sampling: fixed before they are numbered
    sorted_words = word.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    within = Window.partitionBy("language", "part").orderBy(F.desc("n"), "word")
    before = Window.partitionBy("language").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range and language
    starts = sorted_words.groupBy("language", "part").agg(F.count("*").alias("size")).select("language", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    numbered = sorted_words.withColumn("k", F.row_number().over(within))
    return numbered.join(F.broadcast(starts), ["language", "part"]).select("language", "word", (F.col("start") + F.col("k")).alias("rank"))


def _covered(part: pa.RecordBatch, known: pa.Array, share: float, vocabulary: int) -> pa.RecordBatch:
    """The coverage ranks of documents of one language, or what is needed to find them; known: its words in order of their ranks."""
    words, counts = part.column("words"), part.column("counts")
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words, counts = words.flatten(), counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rank = pc.fill_null(pc.index_in(words, value_set=known), vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    doc, stop = np.repeat(np.arange(len(size)), size), np.cumsum(size)
    order = np.argsort(doc * (vocabulary + 2) + rank)
    upto = np.concatenate([[0], np.cumsum(counts[order])])
    some = size > 0
    begin = (stop - size)[some]
    total = np.zeros(len(size), np.int64)
    total[some] = upto[stop[some]] - upto[begin]
    target = share * total
    # the first word of each document with which its target is reached
    short = (upto[1:] - upto[(stop - size)[doc]] < target[doc]).astype(np.int64)
    coverage = np.full(len(size), np.nan)
    if some.any():
        coverage[some] = rank[order[begin + np.add.reduceat(short, begin)]]
    tail = coverage > vocabulary
    rare = (rank > vocabulary) & tail[doc]
    n = np.bincount(doc[rare], minlength=len(size))
    at = pa.array(np.append(0, np.cumsum(n)).astype(np.int32), mask=np.append(~tail, False))
    rarer = [pa.ListArray.from_arrays(at, words.filter(pa.array(rare))), pa.ListArray.from_arrays(at, pa.array(counts[rare]))]
    covered = total - np.bincount(doc[rare], weights=counts[rare], minlength=len(size)).astype(np.int64)
    more = [pa.array(coverage, mask=tail | ~some), pa.array(target, mask=~tail), pa.array(covered, mask=~tail), *rarer]
    names = ["doc_id", "language", "sentence_words", "word_chars"]
    return pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *more], [*names, "coverage_rank", "target", "covered", "rarer", "rarer_counts"])


def coverage_ranks(measured: DataFrame, share: float, vocabulary: int) -> DataFrame:
    """The measures with `coverage_rank` instead of the words; `vocabulary` doesn't change it."""
    spark = measured.sparkSession
    use_shared_checkpoints(spark)
    word = measured.select("language", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("language", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n")).persist()
    ranked = _ranked(word)
    # at most `vocabulary` words for each of the languages that language_of knows, in order of their ranks
    first = ranked.where(F.col("rank") <= vocabulary).groupBy("language").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("x"))
    ranks = {r["language"]: r["words"] for r in first.select("language", F.col("x.word").alias("words")).collect()}
    shared = spark.sparkContext.broadcast(ranks)
    # of documents whose rank lies beyond the vocabulary: the words to cover, those covered, and the rarer words
    schema = _with_id(
        measured, *MEASURES.fields[:3], T.StructField("coverage_rank", T.DoubleType()), T.StructField("target", T.DoubleType()), T.StructField("covered", T.LongType()),
        T.StructField("rarer", T.ArrayType(T.StringType())), T.StructField("rarer_counts", T.ArrayType(T.LongType())),
    )

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {language: pa.array(words, pa.string()) for language, words in shared.value.items()}
        for batch in batches:
            language = np.array(batch.column("language").to_pylist(), object)
            for own in set(language.tolist()):
                part = batch.filter(pa.array(language == own)) if own is not None else batch.filter(pc.is_null(batch.column("language")))
                yield _covered(part, known.get(own, pa.array([], pa.string())), share, vocabulary)

    columns = ["doc_id", "language", "sentence_words", "word_chars", "coverage_rank"]
    covered = measured.mapInArrow(cover, schema).persist()
    tail = covered.where("target is not null")
    if tail.isEmpty():
        word.unpersist()
        out = covered.select(*columns).checkpoint()
        covered.unpersist()
        return out
    key = F.xxhash64("doc_id", "language", "rarer", "rarer_counts").alias("key")
    words = tail.select(key, "language", "target", "covered", "rarer", "rarer_counts").dropDuplicates(["key"])
    words = words.select("key", "language", "target", "covered", F.explode(F.arrays_zip("rarer", "rarer_counts")).alias("x"))
    words = words.select("key", "language", "target", "covered", F.col("x.rarer").alias("word"), F.col("x.rarer_counts").alias("n"))
    upto = F.col("covered") + F.sum("n").over(Window.partitionBy("key").orderBy("rank"))
    reached = words.join(ranked, ["language", "word"]).withColumn("upto", upto).where("upto >= target").groupBy("key").agg(F.min("rank").cast("double").alias("coverage_rank"))
    exact = tail.drop("coverage_rank").withColumn("key", key).join(reached, "key", "left")
    out = covered.where("target is null").select(*columns).unionByName(exact.select(*columns)).checkpoint()
    word.unpersist()
    covered.unpersist()
    return out


_CALIBRATE = """
WITH points AS (
  SELECT doc_id, language, stack(3, 'coverage', ln(1 + coverage_rank), 'sentence', ln(1 + sentence_words), 'word', ln(1 + word_chars)) AS (measure, x)
  FROM {measures} WHERE language IS NOT NULL
), spreads AS (
  SELECT language, measure, percentile_approx(x, 0.5, 1000) AS middle, greatest(0.02, (percentile_approx(x, 0.9, 1000) - percentile_approx(x, 0.1, 1000)) / 2) AS spread
  FROM points GROUP BY language, measure
), scaled AS (
  SELECT p.doc_id, p.language, p.measure, (p.x - s.middle) / s.spread AS z FROM points p JOIN spreads s USING (language, measure)
), rated AS (
  SELECT s.language, s.measure, r.band, s.z FROM scaled s JOIN (SELECT DISTINCT doc_id, band, labeller FROM {ratings} WHERE band IS NOT NULL) r USING (doc_id)
), own AS (
  SELECT language, measure, band, count(*) AS n, percentile_approx(z, 0.5, 1000) AS middle FROM rated GROUP BY ALL
), pooled AS (
  SELECT measure, band, percentile_approx(z, 0.5, 1000) AS middle FROM rated GROUP BY ALL
), centres AS (
  SELECT l.language, p.measure, p.band, coalesce(o.n, 0) AS n,
         (coalesce(o.n * o.middle, 0) + {prior} * p.middle) / (coalesce(o.n, 0) + {prior}) AS middle
  FROM pooled p CROSS JOIN (SELECT DISTINCT language FROM spreads) l LEFT JOIN own o ON o.language = l.language AND o.measure = p.measure AND o.band = p.band
), widths AS (
  SELECT c.language, c.measure, c.band, c.middle, w.width FROM centres c
  JOIN (SELECT r.measure, r.band, greatest(0.1, 1.5 * percentile_approx(abs(r.z - c.middle), 0.5, 1000)) AS width
        FROM rated r JOIN centres c ON c.language = r.language AND c.measure = r.measure AND c.band = r.band GROUP BY ALL) w
    ON w.measure = c.measure AND w.band = c.band
)
SELECT language, measure, CAST(band AS INT) AS band, middle, width FROM widths
"""


def calibrate(measures: DataFrame, ratings: DataFrame, prior: int = 4) -> DataFrame:
    """language, measure, band, middle, width: where the raters' bands lie."""
    return measures.sparkSession.sql(_CALIBRATE, measures=measures, ratings=ratings.select("doc_id", "band", "labeller"), prior=prior)


_BANDS = """
WITH points AS (
  SELECT doc_id, language, stack(3, 'coverage', ln(1 + coverage_rank), 'sentence', ln(1 + sentence_words), 'word', ln(1 + word_chars)) AS (measure, x)
  FROM {measures} WHERE language IS NOT NULL
), spreads AS (
  SELECT language, measure, percentile_approx(x, 0.5, 1000) AS middle, greatest(0.02, (percentile_approx(x, 0.9, 1000) - percentile_approx(x, 0.1, 1000)) / 2) AS spread
  FROM points GROUP BY language, measure
), offsets AS (
  SELECT b.language, b.band,
         array_agg(struct(b.measure AS measure, s.middle + b.middle * s.spread AS middle, b.width * s.spread AS width)) AS at, sum(ln(b.width)) AS cost
  FROM {bands} b JOIN spreads s USING (language, measure) GROUP BY b.language, b.band
), near AS (
  SELECT language, array_agg(struct(band, at, cost)) AS bands FROM offsets GROUP BY language
)
SELECT m.doc_id, m.language, m.coverage_rank, m.sentence_words, m.word_chars,
       coalesce(array_min(transform(n.bands, b -> struct(
         b.cost + aggregate(b.at, 0D, (sum, p) -> sum + least(25D, power(
           (CASE p.measure WHEN 'coverage' THEN ln(1 + m.coverage_rank) WHEN 'sentence' THEN ln(1 + m.sentence_words) ELSE ln(1 + m.word_chars) END - p.middle) / p.width, 2)) / 2) AS distance,
         b.band AS band))).band, CASE WHEN r.any THEN 2 END) AS band
FROM {measures} m LEFT JOIN near n ON n.language = m.language CROSS JOIN (SELECT count(*) > 0 AS any FROM {bands}) r
"""


def reading_bands(docs: DataFrame, ratings: DataFrame, least_chars: int = 200, share: float = 0.9, vocabulary: int = 20_000) -> DataFrame:
    """doc_id, language, coverage_rank, sentence_words, word_chars, band.

    docs: doc_id, text. ratings: doc_id, band, labeller.
    """
    docs = docs.select("doc_id", "text").where(F.length("text") >= least_chars)
    measured = spread(docs).mapInArrow(_measure, _with_id(docs, *MEASURES.fields)).persist()
    # a few numbers per document, read by many steps of the calibration: cut off from their lineage
    measures = coverage_ranks(measured, share, vocabulary)
    measured.unpersist()
    bands = calibrate(measures, ratings).checkpoint()
    return docs.sparkSession.sql(_BANDS, measures=measures, bands=bands)
