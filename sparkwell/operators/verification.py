"""Claims against sources: support by shared words, reports, judging, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens, split_sentences

SUPPORT, PASS_GROUNDED, PASS_COVERED = 0.45, 0.7, 0.5
# Fixed value: what an answer says that finds nothing in the sources.
INSUFFICIENT = "The available sources do not contain enough information to answer this question."


def split_claims(answers: DataFrame) -> DataFrame:
    """qid, claim_no, claim, cited: sentences without their markers.

    A piece with fewer than three characters left gives its markers to the claim before it.
    """
    pieces = answers.select("qid", F.posexplode(split_sentences(F.col("answer"))).alias("at", "raw"))
    pieces = pieces.withColumn("claim", F.trim(F.regexp_replace(F.regexp_replace("raw", r"\[\d{1,2}\]", ""), r"\s+", " ")))
    pieces = pieces.withColumn("marks", F.transform(F.regexp_extract_all("raw", F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int")))
    order = Window.partitionBy("qid").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("whole", F.length("claim") >= 3).withColumn("claim_no", F.sum(F.col("whole").cast("int")).over(order))
    joined = pieces.where("claim_no > 0").groupBy("qid", "claim_no").agg(F.max(F.when(F.col("whole"), F.col("claim"))).alias("claim"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("marks")))).alias("cited"))
    return joined.select("qid", "claim_no", "claim", "cited")


def support(claims: DataFrame, sources: DataFrame, least: float = SUPPORT) -> DataFrame:
    """qid, claim_no, best, supported: the best share of a claim's words that one source has.

    sources: qid, marker, text. A claim that cites none of them is held against all. A claim without words is supported.
    """
    c = claims.select("qid", "claim_no", "cited", content_tokens(F.col("claim")).alias("words"))
    s = sources.select("qid", "marker", content_tokens(F.col("text")).alias("source_words"))
    met = c.join(s, "qid", "left")
    cites = F.coalesce(F.array_contains("cited", F.col("marker")), F.lit(False))
    any_cited = F.max(cites.cast("int")).over(Window.partitionBy("qid", "claim_no")) == 1
    met = met.withColumn("in_pool", ~any_cited | cites)
    share = F.size(F.array_intersect("words", "source_words")) / F.size("words")
    best = met.where("in_pool").groupBy("qid", "claim_no").agg(F.max(F.when(F.size("words") == 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0)))).alias("best"))
    return best.withColumn("supported", F.col("best") >= least)


def _abstains(answer: Column) -> Column:
    return F.regexp_replace(answer, r"^\s+|\s+$", "") == INSUFFICIENT


def report(answers: DataFrame, claims: DataFrame, supported: DataFrame) -> DataFrame:
    """qid, n_claims, groundedness, coverage, passed of every answer (qid, answer).

    An answer that honestly says that the sources tell nothing passes; any other without claims (null, empty) fails.
    """
    rows = claims.join(supported, ["qid", "claim_no"])
    share = lambda c: F.round(F.avg(c.cast("double")), 3)
    per = rows.groupBy("qid").agg(F.count("*").alias("n"), share(F.col("supported")).alias("grounded"), share(F.size("cited") > 0).alias("cited"))
    out = answers.select("qid", F.coalesce(_abstains(F.col("answer")), F.lit(False)).alias("abstains")).join(per, "qid", "left")
    number = lambda c, rest: F.when(F.col("abstains"), F.lit(rest)).otherwise(F.coalesce(F.col(c), F.lit(0).cast("double")))
    out = out.select("qid", "abstains", F.when(F.col("abstains"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_claims"), number("grounded", 1.0).alias("groundedness"), number("cited", 1.0).alias("coverage"))
    passed = F.col("abstains") | (F.col("groundedness") >= PASS_GROUNDED) & (F.col("coverage") >= PASS_COVERED)
    return out.withColumn("passed", passed).drop("abstains")


def feedback(answers: DataFrame, claims: DataFrame, supported: DataFrame, most: int = 6) -> DataFrame:
    """qid, n, problem: the first claims that no source supports or that cite nothing, of answers that don't abstain."""
    said = answers.where(~_abstains(F.col("answer"))).select("qid")
    bad = claims.join(said, "qid", "left_semi").join(supported, ["qid", "claim_no"]).where(~F.col("supported") | (F.size("cited") == 0))
    n = F.row_number().over(Window.partitionBy("qid").orderBy("claim_no"))
    why = F.when(~F.col("supported"), "not supported by its sources").otherwise("cites no source")
    return bad.withColumn("n", n).where(F.col("n") <= most).select("qid", "n", F.concat(F.lit("- "), "claim", F.lit(": "), why).alias("problem"))


def judge(answers: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """qid, faithfulness, relevance; answers: qid, question, answer; sources: qid, marker, text.

    Faithfulness is the mean, over claims with words, of the best share of words that any one source has. Without
    claims or sources both are 0; an honest abstention has 1 in both.
    """
    c = claims.select("qid", "claim_no", content_tokens(F.col("claim")).alias("words"))
    best = c.where(F.size("words") > 0).join(sources.select("qid", content_tokens(F.col("text")).alias("own")), "qid").groupBy("qid", "claim_no").agg(F.max(F.size(F.array_intersect("words", "own")) / F.size("words")).alias("best"))
    faith = best.groupBy("qid").agg(F.round(F.avg("best"), 3).alias("faith"))
    judged = claims.select("qid").distinct().join(sources.select("qid").distinct(), "qid", "left_semi").withColumn("judged", F.lit(True))
    q, a = content_tokens(F.col("question")), content_tokens(F.col("answer"))
    relevance = F.round(F.coalesce(F.size(F.array_intersect(q, a)) / F.nullif(F.size(q), F.lit(0)), F.lit(1.0)), 3)
    rows = answers.select("qid", F.coalesce(_abstains(F.col("answer")), F.lit(False)).alias("abstains"), relevance.alias("relevant")).join(faith, "qid", "left").join(judged, "qid", "left")
    score = lambda c: F.when(F.col("abstains"), 1.0).when(F.col("judged"), F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    return rows.select("qid", score("faith").alias("faithfulness"), score("relevant").alias("relevance"))


def extract_answers(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """qid, answer: the sentence that shares most words with the question, and at most one more.

    The second shares at least two words, at most one fewer than the first, and comes
    from another source unless it shares as many. sources: qid, marker, text.
    """
    words = questions.select("qid", content_tokens(F.col("question")).alias("asked"))
    said = sources.select("qid", "marker", F.posexplode(split_sentences(F.col("text"))).alias("at", "sentence"))
    # one row per word: the shared words are counted by a join, and a sentence is tokenised once
    said_words = said.select("qid", "marker", "at", "sentence", F.explode(content_tokens(F.col("sentence"))).alias("w"))
    asked = words.select("qid", F.explode("asked").alias("w"))
    met = said_words.join(asked, ["qid", "w"]).groupBy("qid", "marker", "at", "sentence").agg(F.count("*").alias("n"))
    order = Window.partitionBy("qid").orderBy(F.desc("n"), "marker", "at")
    ranked = met.withColumn("place", F.row_number().over(order))
    first = ranked.where("place = 1").select("qid", F.col("n").alias("best"), F.col("marker").alias("first_marker"), F.col("sentence").alias("first_sentence"))
    rest = ranked.where("place > 1").join(first, "qid")
    fits = (F.col("n") >= F.greatest(F.lit(2), F.col("best") - 1)) & (F.col("sentence") != F.col("first_sentence")) & ((F.col("marker") != F.col("first_marker")) | (F.col("n") == F.col("best")))
    second = rest.where(fits).groupBy("qid").agg(F.min_by(F.struct("sentence", "marker"), "place").alias("second"))
    cited = lambda s, m: F.concat(s, F.lit(" ["), m.cast("string"), F.lit("]"))
    out = first.join(second, "qid", "left")
    text = F.concat_ws(" ", cited(F.col("first_sentence"), F.col("first_marker")), F.when(F.col("second").isNotNull(), cited(F.col("second.sentence"), F.col("second.marker"))))
    return out.select("qid", text.alias("answer"))


def score_items(answers: DataFrame) -> DataFrame:
    """qid, correct, cited: all expected substrings are in the answer; it has a marker."""
    low = F.lower("answer")
    return answers.select("qid", "category", F.forall("expected_substrings", lambda s: F.contains(low, F.lower(s))).alias("correct"), F.col("answer").rlike(r"\[\d{1,2}\]").alias("cited"))


def summarise(scored: DataFrame) -> DataFrame:
    n = F.count("*")
    return scored.groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(n.alias("n"), F.count_if("correct").alias("n_correct"), F.count_if("cited").alias("n_cited"), F.round(F.count_if("correct") / n, 4).alias("pass_rate"))
