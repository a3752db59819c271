"""Mixing of sources to target weights.

Token counts come from a public tokenizer whose file is a parameter. The total is
the largest that no source's documents, used max_repeats times, fall short of.
Every source uses all its documents equally often, and in the last round as many
of them, in the order of a hash of the id, as fit into what is left.

The order of the mix is a proportionate-fair schedule. A source of weight w has the
release time floor(k / w) and the deadline ceil((k + 1) / w) for its block k of
`block_tokens` tokens; earliest deadline first among the released blocks fills one
slot after another, so a source is never a whole block away from its share. With
weights of a common denominator H the schedule repeats every H slots. One such
period, whose length is bounded by `max_period` whatever the data, is made once;
each block finds its slot by its number, so no task goes through all blocks.

Running sums are taken in two levels: within a range of hash values, and over the
sums of the ranges of a source, whose number follows that of the documents.

Defined results: source names are matched without case, blanks and the kind of
dash; documents of other sources, or without one, are never drawn. Null and empty
texts have 0 tokens and are never drawn. Targets without documents or with a share of 0 or
less have no part, and the shares of the others are scaled to 1. max_repeats null
counts as 1. Repeated target rows count once.
"""

import base64
import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread, use_shared_checkpoints

BLOCK_TOKENS = 65_536
MAX_PERIOD = 10_000
#: Ranges of hash values that running sums are taken in: RANGES at least, and one for so many documents.
RANGES, RANGE_DOCS = 512, 100_000
# Fixed value: how the public byte-level vocabularies split a text first.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def _encoding(path: str, pattern: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counter(path: str, pattern: str = PATTERN):
    """A pandas UDF: tokens of whole texts by the vocabulary file at `path`."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path, pattern)
        for texts in batches:
            yield texts.map(lambda text: len(encoding.encode_ordinary(text)), na_action="ignore").fillna(0).astype("int64")

    return F.pandas_udf(count, T.LongType())


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "_")


def pfair_period(weights: dict[str, float], max_period: int = MAX_PERIOD) -> tuple[int, dict[str, list[int]]]:
    """One period of the schedule: its length and the slots of each source, in order."""
    total = sum(weights.values())
    if total <= 0:
        return 0, {}
    parts = {s: Fraction(w / total).limit_denominator(max_period) for s, w in sorted(weights.items()) if w > 0}
    period = math.lcm(*(p.denominator for p in parts.values())) if parts else 0
    if period > max_period or sum(parts.values()) != 1:
        # the nearest weights with max_period as denominator, at least one slot each
        period = max(max_period, len(parts))
        counts = {s: max(1, math.floor(weights[s] / total * period)) for s in parts}
        order = sorted(parts, key=lambda s: (counts[s] - weights[s] / total * period, s))
        k = 0
        while (left := period - sum(counts.values())) != 0:
            s = order[k % len(order)] if left > 0 else max(counts, key=lambda s: (counts[s], s))
            counts[s] += 1 if left > 0 else -1
            k += 1
    else:
        counts = {s: int(p * period) for s, p in parts.items()}
    waiting: list[tuple[int, str, int]] = [(0, s, 0) for s in counts]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in counts}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // counts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(slot)
        if k + 1 < counts[s]:
            heapq.heappush(waiting, ((k + 1) * period // counts[s], s, k + 1))
    return period, slots


def mix_sources(docs: DataFrame, targets: DataFrame, counter, block_tokens: int = BLOCK_TOKENS, max_period: int = MAX_PERIOD, ranges: int = RANGES) -> DataFrame:
    """The drawn documents: doc_id, source, repeat_no, repeats, tokens, block, slot.

    docs: doc_id, source, text. targets: source, target_share, max_repeats.
    `repeats` is how often the document is used in all; `slot` orders the mix.
    """
    spark = docs.sparkSession
    targets = targets.groupBy(source_key(F.col("source")).alias("key")).agg(F.max("target_share").alias("share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("most"), F.min("source").alias("target"))
    keys = [r for r in targets.where("share > 0 and most > 0 and key is not null").limit(max_period + 1).collect()]
    if len(keys) > max_period:
        raise ValueError("more sources than the period has slots")
    table = spark.createDataFrame([(r["key"], r["target"]) for r in keys], T.StructType([T.StructField("key", T.StringType()), T.StructField("target", T.StringType())]))
    use_shared_checkpoints(spark)
    # a count of rows reads no texts
    ranges = max(ranges, docs.count() // RANGE_DOCS)
    # as many rows as there are targets, max_period at most
    sized = spread(docs.select("doc_id", "source", "text")).select("doc_id", source_key(F.col("source")).alias("key"), counter(F.col("text")).alias("tokens")).join(F.broadcast(table), "key")
    sized = sized.where("tokens > 0").withColumn("h", F.xxhash64("doc_id")).withColumn("range", F.pmod(F.shiftrightunsigned("h", 40), F.lit(ranges)))
    # tokens are counted once, then read by the sums and the schedule
    sized = sized.select("doc_id", "key", "target", "tokens", "h", "range").checkpoint()
    sums = sized.groupBy("key", "range").agg(F.sum("tokens").alias("sum"))
    per_source = {r["key"]: r["sum"] for r in sums.groupBy("key").agg(F.sum("sum").alias("sum")).collect()}
    present = [r for r in keys if per_source.get(r["key"], 0) > 0]
    scale = sum(r["share"] for r in present)
    total = min((per_source[r["key"]] * r["most"] * scale / r["share"] for r in present), default=0)
    plan = []
    period, slots = pfair_period({r["key"]: r["share"] for r in present}, max_period)
    for r in present:
        have = per_source[r["key"]]
        budget = min(int(total * r["share"] / scale), have * r["most"])
        plan.append((r["key"], have, budget // have, budget % have, len(slots[r["key"]])))
    plan_df = spark.createDataFrame(plan, T.StructType([T.StructField("key", T.StringType()), T.StructField("have", T.LongType()), T.StructField("rounds", T.LongType()), T.StructField("rest", T.LongType()), T.StructField("per_period", T.LongType())]))
    pattern = spark.createDataFrame([(s, k, slot) for s, own in slots.items() for k, slot in enumerate(own)], T.StructType([T.StructField("key", T.StringType()), T.StructField("k", T.LongType()), T.StructField("at", T.LongType())]))

    over_ranges = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("sum").over(over_ranges), F.lit(0)))
    within = Window.partitionBy("key", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("upto", F.sum("tokens").over(within)).join(offsets.select("key", "range", "offset"), ["key", "range"])
    placed = placed.withColumn("upto", F.col("upto") + F.col("offset")).join(F.broadcast(plan_df), "key")
    placed = placed.withColumn("repeats", F.col("rounds") + (F.col("upto") <= F.col("rest")).cast("long")).where("repeats > 0")
    drawn = placed.withColumn("repeat_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    drawn = drawn.withColumn("block", F.floor(((F.col("repeat_no") - 1) * F.col("have") + F.col("upto") - F.col("tokens")) / F.lit(block_tokens)).cast("long"))
    drawn = drawn.withColumn("k", F.pmod("block", "per_period"))
    drawn = drawn.join(F.broadcast(pattern), ["key", "k"])
    slot = F.floor(F.col("block") / F.col("per_period")).cast("long") * period + F.col("at")
    return drawn.select("doc_id", F.col("target").alias("source"), "repeat_no", "repeats", "tokens", "block", slot.alias("slot"))


def actual_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: documents, uses, tokens and the actual share beside the target share."""
    got = mix.groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_uses"), F.sum("tokens").alias("tokens"), F.max("repeats").alias("most_repeats"))
    everything = got.agg(F.sum("tokens").alias("all_tokens"))
    out = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # one row per target on either side of these joins
    out = out.join(got, "source", "left").join(F.broadcast(everything), how="left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_docs", "n_uses", "tokens", "most_repeats")}
    return out.withColumns(zero).withColumn("actual_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))).drop("all_tokens")
