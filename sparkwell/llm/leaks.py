"""Evaluation items that leaked into documents.

The sentences of all items are indexed once: every term has postings (sentence,
impact), ordered by sentence and cut into blocks that carry their largest impact. An
impact is the term's BM25 weight in the sentence, divided by the sum of that
sentence's weights, so a score is the share of the sentence that a query covers and
one threshold holds for long and short sentences. Every sentence of every document
is a query. Block-max WAND goes through the postings of its terms: sentences whose
bound stays below the threshold are passed over, whole blocks at a time; all others
come out, without a limit on their number.

Each retrieved pair is verified: names, codes and figures (the terms that few items
have) and all terms must overlap enough, in any order, so that a text of
the same kind about other names or figures is none. A document holds an item if it
holds its whole question, however many documents do, or two different sentences of its
passage that are no stock sentences. A sentence is stock if passages that have nothing
else in common hold it, or if it stands in more contexts than `stock_share` of the documents
would by chance: `stock_sigmas` deviations more. Documents whose other sentences are
partly the same are one context: near copies don't make a leak stock.

Terms, their frequencies and impacts are counted by Spark. The index goes to tasks in shards of
`shard_sentences` sentences; tasks hold one unpacked at a time, and documents are read
and split once for all of them. Texts are compared after NFKC, without markup, entities, case and
white space between Chinese characters.

Defined results: null or empty texts, questions and passages match nothing. Repeated
items and documents give one row. Items with the same passage all leak with it. A
passage with fewer than two sentences that aren't stock leaks by its question only.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import use_shared_checkpoints
from .sentences import sentence_ends

K1, B = 1.5, 0.75
POSTING_BLOCK = 32
#: Min-hashes of the other sentences around one; texts with one of them in common are one context. Fixed odd factors.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09, 0xA3B19535, 0x4CF5AD43, 0x2745937F, 0x38B34AE5, 0x7FEB352D, 0x846CA68B, 0x1B873593, 0xE6546B65], dtype=np.uint32)
#: Of documents, which share most of their sentences if they are near copies; and of passages, which are short.
DOCUMENT_SLOTS, PASSAGE_SLOTS = 4, 16
#: Sentences whose results a task keeps at a time.
KNOWN = 100_000

_CJK = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
_HAS_CJK = re.compile(f"[{_CJK}]")
_HAS_ARABIC = re.compile("[؀-ۿ]")
_GAP = re.compile(f"[ \t　](?<=[{_CJK}][ \t　])(?=[{_CJK}])")
_HAS_MARKUP = re.compile("[*`_~<​‌‍⁠﻿­]")
_MARKUP = re.compile(r"[*`_~]+|<[^<>\n]{1,200}>|[​‌‍⁠﻿­]")
_TERM = re.compile(f"[{_CJK}]+|(?:(?![{_CJK}])[^\\W_])+")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile("[a-z0-9]+")
_MARKS = re.compile("[\u0300-\u036f\u064b-\u065f\u0670\u0640]")
# Letters of Arabic script that stand for one another, and digits.
_FOLD = str.maketrans("يىكہۀةهٱأإآھے٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "ییکههههااااهی01234567890123456789")


def cleaned(text: str) -> str:
    """The text without what light edits add: entities, markup, other forms of the same letters."""
    if "&" in text:
        text = html.unescape(text)
    if _HAS_MARKUP.search(text):
        text = _MARKUP.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        if _HAS_ARABIC.search(text):
            text = text.translate(_FOLD)
        if _HAS_CJK.search(text):
            text = _GAP.sub("", text)
    return text.replace("\r\n", "\n") if "\r" in text else text


def terms(sentence: str) -> list[str]:
    """Words, numbers and codes in lower case; Chinese runs as pairs of characters."""
    sentence = sentence.lower()
    if sentence.isascii():
        return _ASCII_WORD.findall(sentence)
    if not _HAS_CJK.search(sentence):
        return _WORD.findall(sentence)
    out = []
    for w in _TERM.findall(sentence):
        if _HAS_CJK.match(w):
            out += [w[k : k + 2] for k in range(len(w) - 1)] or [w]
        else:
            out.append(w)
    return out


class ItemIndex:
    """Postings with block maxima over item sentences, plus what verification needs."""

    def __init__(self, rows: list[tuple[int, bool, list[tuple[str, float, bool]]]]):
        """rows: the id of a sentence, whether it is a question, and (term, impact, rare) of its terms."""
        rows = sorted(rows, key=lambda r: r[0])
        self.ids = [r[0] for r in rows]
        self.question = [r[1] for r in rows]
        self.all = [frozenset(t for t, _, _ in r[2]) for r in rows]
        # names, codes and figures: few items have them
        self.rare = [frozenset(t for t, _, rare in r[2] if rare) for r in rows]
        self.docs: dict[str, list[int]] = defaultdict(list)
        self.impact: dict[str, list[float]] = defaultdict(list)
        for s, (_, _, own) in enumerate(rows):
            for t, w, _ in own:
                self.docs[t].append(s)
                self.impact[t].append(w)
        self.docs, self.impact = dict(self.docs), dict(self.impact)
        self.highest = {t: max(w) for t, w in self.impact.items()}
        self.block_max = {t: [max(w[k : k + POSTING_BLOCK]) for k in range(0, len(w), POSTING_BLOCK)] for t, w in self.impact.items()}

    def search(self, query: set[str], threshold: float) -> list[tuple[int, float]]:
        """All sentences that score at least `threshold`, by block-max WAND."""
        highest, docs, impact, block_max = self.highest, self.docs, self.impact, self.block_max
        # term, position in its postings, current sentence
        lists = [[docs[t][0], 0, t] for t in query if t in highest]
        if sum(highest[x[2]] for x in lists) < threshold:
            return []
        found = []
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += highest[x[2]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == at:
                pivot += 1
            # the bound by the blocks in which `at` lies, and where the first of them ends
            near, jump = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 60
            for x in lists[: pivot + 1]:
                t = x[2]
                k = bisect_left(docs[t], at, x[1])
                if k < len(docs[t]):
                    b = k // POSTING_BLOCK
                    near += block_max[t][b]
                    jump = min(jump, docs[t][min(len(docs[t]), (b + 1) * POSTING_BLOCK) - 1] + 1)
            if near >= threshold and lists[0][0] == at:
                score = 0.0
                for x in lists[: pivot + 1]:
                    score += impact[x[2]][x[1]]
                if score >= threshold:
                    found.append((at, score))
                target = at + 1
            elif near >= threshold:
                target = at
            else:
                target = max(at + 1, jump)
            for x in lists[: pivot + 1]:
                if x[0] < target:
                    own = docs[x[2]]
                    x[1] = bisect_left(own, target, x[1])
                    x[0] = own[x[1]] if x[1] < len(own) else -1
            lists = [x for x in lists if x[0] >= 0]
        return found


def _hashes(sentences: list[str], slots: int) -> np.ndarray:
    """(sentence, slot), the same however a sentence is spaced and capitalised."""
    each = np.array([zlib.crc32(" ".join(terms(x)).encode("utf-8", "replace")) for x in sentences], dtype=np.uint32)
    mixed = each[:, None] * _FACTORS[:slots]
    mixed ^= mixed >> np.uint32(15)
    return mixed * np.uint32(0x2C1B3C6D)


def context_of(sentences: list[str], slots: int = DOCUMENT_SLOTS) -> list[int]:
    """Min-hashes of the sentences, the same in any order."""
    sentences = [x for x in sentences if terms(x)]
    return _hashes(sentences, slots).min(axis=0).tolist() if sentences else [-1] * slots


def contexts_without(sentences: list[str], slots: int = PASSAGE_SLOTS) -> list[list[int]]:
    """For each sentence the min-hashes of all others; -1 where there is none."""
    h = _hashes(sentences, slots).astype(np.int64)
    out = np.full(h.shape, -1, np.int64)
    for k in range(slots if len(sentences) > 1 else 0):
        column = h[:, k]
        least = int(column.argmin())
        out[:, k] = column[least]
        # equal sentences are one
        others = column[column != column[least]]
        out[column == column[least], k] = others.min() if len(others) else -1
    return out.tolist()


ITEM_SENTENCE = [T.StructField("sentence", T.StringType()), T.StructField("is_question", T.BooleanType()), T.StructField("passage", T.IntegerType()), T.StructField("context", T.ArrayType(T.LongType()))]


def item_sentences(items: DataFrame) -> DataFrame:
    """item_id, sentence, is_question, passage (a hash), context: what each item is made of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, question, passage in zip(pdf["item_id"], pdf["question"], pdf["passage"]):
                if question:
                    rows.append((item, cleaned(question).strip(), True, None, None))
                passage = cleaned(passage) if passage else ""
                ends = sentence_ends([passage])[0].tolist() if passage else []
                own = [x.strip() for x in (passage[a:b] for a, b in zip([0, *ends], ends))]
                name = zlib.crc32(passage.encode("utf-8", "replace")) - (1 << 31)
                rows += [(item, x, False, name, context) for x, context in zip(own, contexts_without(own) if own else [])]
            out = pd.DataFrame(rows, columns=["item_id", *[f.name for f in ITEM_SENTENCE]])
            yield out.astype({"passage": "Int32"})

    return items.select("item_id", "question", "passage").mapInPandas(run, T.StructType([items.schema["item_id"], *ITEM_SENTENCE])).where("sentence <> ''").distinct()


def item_postings(sentences: DataFrame, rare_df: int) -> DataFrame:
    """sentence, is_question, terms (term, impact, rare): the impact is a term's share of its sentence's BM25 weight."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sentence in pdf["sentence"]:
                bag = Counter(terms(sentence))
                size = sum(bag.values())
                rows += [(sentence, t, n, size) for t, n in bag.items()]
            yield pd.DataFrame(rows, columns=["sentence", "term", "tf", "size"])

    counted = sentences.select("sentence").distinct().mapInPandas(count, "sentence string, term string, tf long, size long")
    total = counted.groupBy("sentence").agg(F.first("size").alias("size")).agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    spread = counted.select("sentence", "term").join(sentences.select("sentence", "item_id").distinct(), "sentence").groupBy("term").agg(F.countDistinct("item_id").alias("items"))
    # total is one row
    met = counted.join(df.join(spread, "term"), "term").join(F.broadcast(total))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    rare = (F.col("items") <= rare_df) | F.col("term").rlike(r"\d")
    own = met.withColumn("w", weight).groupBy("sentence").agg(F.sum("w").alias("all"), F.collect_list(F.struct("term", "w", rare.alias("rare"))).alias("terms"))
    asked = sentences.groupBy("sentence").agg(F.max("is_question").alias("is_question"))
    shares = F.transform("terms", lambda x: F.struct(x["term"].alias("term"), (x["w"] / F.col("all")).alias("impact"), x["rare"].alias("rare")))
    return own.join(asked, "sentence").select(F.xxhash64("sentence").alias("id"), "is_question", shares.alias("terms"))


def _verified(index: ItemIndex, query: set[str], threshold: float, all_share: float, rare_share: float, question_share: float) -> tuple:
    highest, bound = index.highest, 0.0
    for t in query:
        bound += highest.get(t, 0.0)
    if bound < threshold:
        return ()
    kept = []
    for s, score in index.search(query, threshold):
        own, rare = index.all[s], index.rare[s]
        least = question_share if index.question[s] else all_share
        if len(own & query) >= least * len(own) and len(rare & query) >= rare_share * len(rare):
            kept.append((index.ids[s], score))
    return tuple(kept)


def _matches(batches: Iterator[pd.DataFrame], shards: list, settings: tuple) -> Iterator[pd.DataFrame]:
    """shards: broadcast, packed indexes; with several of them, one at a time is unpacked."""
    only = pickle.loads(shards[0].value) if len(shards) == 1 else None
    # sentences repeat a lot; results of those just seen are looked up
    known: dict[str, tuple] = {}
    for pdf in batches:
        ids, texts = pdf["doc_id"].tolist(), [cleaned(t) for t in pdf["text"]]
        split = [[text[a:b] for a, b in zip([0, *ends[:-1]], ends)] for text, ends in zip(texts, (e.tolist() for e in sentence_ends(texts)))]
        if only is not None:
            for own in split:
                for sentence in own:
                    if sentence not in known:
                        known[sentence] = _verified(only, set(terms(sentence)), *settings)
        else:
            new = {x for own in split for x in own if x not in known}
            asked = [(x, set(terms(x))) for x in new]
            known.update((x, ()) for x in new)
            for shard in shards:
                index = pickle.loads(shard.value)
                for sentence, query in asked:
                    known[sentence] += _verified(index, query, *settings)
        rows = []
        for doc, own in zip(ids, split):
            found: dict[int, float] = {}
            for sentence in own:
                for s, score in known[sentence]:
                    found[s] = max(found.get(s, 0.0), score)
            if found:
                context = context_of([x for x in own if not known[x]])
                rows += [(doc, s, score, context) for s, score in found.items()]
        if len(known) > KNOWN:
            known.clear()
        yield pd.DataFrame(rows, columns=["doc_id", "id", "score", "context"])


def _unrelated(rows: DataFrame, owner: str, slots: int) -> DataFrame:
    """id, n: in how many contexts a sentence stands. rows: id, owner, context.

    A context counts by its first owner, which no min-hash of its own joins to an earlier one.
    """
    first = rows.select("id", owner, F.posexplode("context").alias("slot", "hash")).groupBy("id", "slot", "hash").agg(F.min(owner).alias(owner))
    return first.groupBy("id", owner).agg(F.count("*").alias("k")).where(F.col("k") == slots).groupBy("id").agg(F.count("*").alias("n"))


def find_leaks(
    docs: DataFrame, items: DataFrame, threshold: float = 0.4, all_share: float = 0.55, rare_share: float = 0.5, question_share: float = 0.7, stock_share: float = 0.004, stock_sigmas: float = 4.75, rare_df: int = 3, shard_sentences: int = 100_000
) -> DataFrame:
    """item_id, doc_id, question (held whole), n_sentences (of the passage, without stock), best score.

    docs: doc_id, text. items: item_id, question, passage.
    """
    spark = docs.sparkSession
    use_shared_checkpoints(spark)
    docs = docs.select("doc_id", "text").where("text is not null")
    sentences = item_sentences(items.select("item_id", "question", "passage").dropDuplicates()).checkpoint()
    postings = item_postings(sentences, rare_df).checkpoint()
    n_shards = max(1, -(-postings.count() // shard_sentences))
    packed = []
    for shard in range(n_shards):
        # about shard_sentences rows, as ids are hashes
        rows = [(r["id"], r["is_question"], [tuple(t) for t in r["terms"]]) for r in postings.where(F.pmod("id", F.lit(n_shards)) == shard).toLocalIterator()]
        packed.append(spark.sparkContext.broadcast(pickle.dumps(ItemIndex(rows))))
    settings = (threshold, all_share, rare_share, question_share)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("context", T.ArrayType(T.LongType()))])
    found = docs.mapInPandas(lambda batches: _matches(batches, packed, settings), schema).checkpoint()

    links = sentences.withColumn("id", F.xxhash64("sentence"))
    # one row
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    likely = F.lit(stock_share) * F.col("n_docs")
    # above what chance makes of the share
    many = likely + stock_sigmas * F.sqrt(likely) + stock_sigmas**2 / 4
    stock = _unrelated(found, "doc_id", DOCUMENT_SLOTS).join(F.broadcast(n_docs)).where(F.col("n") > many).select("id")
    passages = links.where("not is_question").select("id", "passage", "context").distinct()
    stock = stock.unionByName(_unrelated(passages, "passage", PASSAGE_SLOTS).where("n > 1").select("id")).withColumn("is_question", F.lit(False)).distinct()
    hits = found.select("doc_id", "id", "score").join(links.select("id", "item_id", "is_question").distinct(), "id").join(stock, ["id", "is_question"], "left_anti")
    per = hits.groupBy("item_id", "doc_id").agg(F.max("is_question").alias("question"), F.countDistinct(F.when(~F.col("is_question"), F.col("id"))).alias("n_sentences"), F.max("score").alias("score"))
    return per.where("question or n_sentences >= 2")
