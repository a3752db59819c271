"""Context assembly: one text once, fusion over tool calls, packing into a budget, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, text_hash

RRF_K, BUDGET, MOST_SOURCES = 60, 2200, 12


def dedupe(evidence: DataFrame) -> DataFrame:
    """The first row of every text of a question, with the best score among its copies."""
    first = Window.partitionBy("qid", "hash").orderBy("ord")
    rows = evidence.withColumn("hash", text_hash(F.col("text")))
    rows = rows.withColumn("n", F.row_number().over(first)).withColumn("score", F.max("score").over(Window.partitionBy("qid", "hash")))
    return rows.where("n = 1").drop("n", "hash")


def fuse_calls(evidence: DataFrame) -> DataFrame:
    """fused_score from the score and the reciprocal rank within each tool call."""
    place = F.row_number().over(Window.partitionBy("qid", "call_id").orderBy("rank", "ord")) - 1
    rows = evidence.withColumn("rrf", 1 / (RRF_K + place))
    share = F.col("rrf") / F.max("rrf").over(Window.partitionBy("qid"))
    return rows.withColumn("fused_score", F.round(0.6 * (F.col("score") + 1) / 2 + 0.4 * share, 4)).drop("rrf")


def pack(evidence: DataFrame, budget: int = BUDGET, most: int = MOST_SOURCES) -> DataFrame:
    """Rows that fit into the budget in the order of fused_score; one that doesn't fit is passed over.

    The fold runs over the evidence of one question, which retrieval has already cut to a few rows.
    """
    item = F.struct((-F.col("fused_score")).alias("neg"), "ord", approx_tokens(F.col("text")).alias("cost"), "id", "text")
    rows = evidence.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("picked"))

    def step(s: Column, x: Column) -> Column:
        fits = (F.size(s["picked"]) < most) & ((F.size(s["picked"]) == 0) | (s["used"] + x["cost"] <= budget))
        return F.struct((s["used"] + F.when(fits, x["cost"]).otherwise(0)).alias("used"), F.when(fits, F.concat(s["picked"], F.array(x["ord"].cast("int")))).otherwise(s["picked"]).alias("picked"))

    rows = rows.withColumn("picked", F.aggregate("items", start, step)["picked"])
    out = rows.select("qid", F.posexplode(F.filter("items", lambda x: F.array_contains(F.col("picked"), x["ord"].cast("int")))).alias("at", "x"))
    return out.select("qid", (F.col("at") + 1).alias("marker"), "x.id", "x.cost", "x.text")


def citations(answers: DataFrame) -> DataFrame:
    """qid, marker, place: the [n] of an answer, once each, in order of first use."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int")))
    return answers.select("qid", F.posexplode(found).alias("place", "marker"))
