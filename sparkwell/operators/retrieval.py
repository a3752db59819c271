"""Ranked retrieval as joins and windows: BM25, hashed and dense vectors, fusion, MaxSim.

Every operator takes a batch of questions. Question sets are the small side; they are
joined by hash on terms or buckets, and Spark broadcasts them only if their size
allows it. Top-k is a window over (question, score), which Spark limits per partition
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import spread, use_shared_checkpoints

K1, B, RRF_K, DIM = 1.5, 0.75, 60, 768


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf, doc_len."""
    words = spread(docs.select(key, text)).select(key, F.explode(tokens(F.col(text))).alias("term"))
    counted = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    return counted.withColumn("doc_len", F.sum("tf").over(Window.partitionBy(key)))


def term_stats(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """term, df, idf; n_docs is the one-row count of documents."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    df = df.join(F.broadcast(n_docs.select("n")))
    return df.select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def top_k(scored: DataFrame, k: int, tie: str, by: str = "qid") -> DataFrame:
    """The k best rows of each question with their rank from 1."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, questions: DataFrame, key: str, k: int = 5, text: str = "text") -> DataFrame:
    """qid, key, score, rank of the best documents of each question (qid, question).

    A term asked twice counts twice; only positive scores rank; ties go by the key.
    """
    use_shared_checkpoints(docs.sparkSession)
    asked = questions.select("qid", F.explode(tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    # documents are tokenised once: a row of the empty term for each tells its length, and of the others only asked ones go on
    said = spread(docs.select(key, text)).select(key, tokens(F.col(text)).alias("words"))
    rows = said.select(key, F.size("words").alias("doc_len"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))
    terms = asked.select("term").unionByName(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    index = rows.join(terms, "term", "left_semi").groupBy(key, "doc_len", "term").agg(F.count("*").alias("tf")).checkpoint()
    stats = index.where("term = ''").agg(F.count("*").alias("n"), F.avg(F.greatest("doc_len", F.lit(0))).alias("avg_len"))
    post = index.where("term <> ''")
    weights = term_stats(post, stats)
    met = asked.join(weights, "term").join(post, "term").join(F.broadcast(stats.select("avg_len")))
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    # sums in another order differ in their last digits; ties must not
    scored = met.groupBy("qid", key).agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    return top_k(scored, k, key)


def feature_weights(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, feature, weight: tokens, and at 0.4 the letter triples of longer tokens."""
    words = spread(docs.select(key, text)).select(key, F.explode(tokens(F.col(text))).alias("t"))
    triples = F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.concat(F.lit("cg:"), F.substring(F.col("t"), i, F.lit(3))))
    features = words.select(key, F.explode(F.when(F.length("t") >= 5, F.concat(F.array("t"), triples)).otherwise(F.array("t"))).alias("feature"))
    counted = features.groupBy(key, "feature").agg(F.count("*").alias("n"))
    return counted.select(key, "feature", ((1 + F.log("n")) * F.when(F.col("feature").startswith("cg:"), 0.4).otherwise(1.0)).alias("weight"))


def hashed_vectors(docs: DataFrame, key: str, text: str = "text", dim: int = DIM) -> DataFrame:
    """key, bucket, value: sparse vectors of unit length, one row per bucket in use."""
    w = feature_weights(docs, key, text)
    digest = F.md5("feature")
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    summed = w.select(key, bucket.alias("bucket"), (F.col("weight") * sign).alias("v")).groupBy(key, "bucket").agg(F.sum("v").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return summed.select(key, "bucket", (F.col("v") / F.when(norm == 0, 1.0).otherwise(norm)).alias("value"))


def sparse_cosine(vectors: DataFrame, asked: DataFrame, key: str, k: int) -> DataFrame:
    """Best documents by cosine of sparse vectors; asked: qid, bucket, value."""
    met = asked.select("qid", "bucket", F.col("value").alias("q")).join(vectors, "bucket")
    return top_k(met.groupBy("qid", key).agg(F.round(F.sum(F.col("q") * F.col("value")), 9).alias("score")), k, key)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(vectors: DataFrame, asked: DataFrame, key: str, vector: str, k: int, most_asked: int = 100_000) -> DataFrame:
    """Exact top-k of dense unit vectors for a batch of questions (qid, q).

    The questions are a stated set that is held against all rows; beyond
    `most_asked` of them they go in several passes, so what is broadcast is bounded.
    """
    passes = max(1, -(-asked.count() // most_asked))
    out = None
    for turn in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == turn)
        scored = vectors.crossJoin(F.broadcast(part)).select("qid", key, dot(F.col("q"), F.col(vector)).alias("score"))
        best = top_k(scored, k, key)
        out = best if out is None else out.unionByName(best)
    return out


def fuse(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, key, rank from 1); ties go by first appearance."""
    all_lists = None
    for n, ranked in enumerate(lists):
        part = ranked.select("qid", key, (F.col("rank") - 1).alias("place"), F.lit(n).alias("source"))
        all_lists = part if all_lists is None else all_lists.unionByName(part)
    fused = all_lists.groupBy("qid", key).agg(F.sum(1 / (RRF_K + F.col("place"))).alias("score"), F.min(F.col("source") * 100_000 + F.col("place")).alias("first"))
    ranked = top_k(fused, k, "first")
    best = F.max("score").over(Window.partitionBy("qid"))
    return ranked.select("qid", key, F.round(F.col("score") / best, 4).alias("score"), "rank")


def max_sim(patches: DataFrame, asked: DataFrame, page: str, k: int) -> DataFrame:
    """Late interaction: for every question vector its best patch of a page, summed.

    patches: page, vec. asked: qid, token, q (a bounded set of question vectors).
    """
    scored = patches.crossJoin(F.broadcast(asked)).select("qid", "token", page, dot(F.col("q"), F.col("vec")).alias("s"))
    best = scored.groupBy("qid", "token", page).agg(F.max("s").alias("s"))
    return top_k(best.groupBy("qid", page).agg(F.sum("s").alias("score")), k, page)


def squash(scores: DataFrame) -> DataFrame:
    """Scores of a question through the logistic function if any of them lies outside [0, 1]."""
    outside = F.max(((F.col("score") < 0) | (F.col("score") > 1)).cast("int")).over(Window.partitionBy("qid")) == 1
    return scores.withColumn("score", F.when(outside, 1 / (1 + F.exp(-F.col("score")))).otherwise(F.col("score")))


def catalogue_lookup(catalogue: DataFrame, questions: DataFrame, key: str, words: Column, k: int = 3) -> DataFrame:
    """Records that share words with a question, most shared first. Joined on the words, not row by row."""
    own = catalogue.select(key, F.explode(F.array_distinct(tokens(words, F.lit("en")))).alias("t"))
    asked = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("question"), F.lit("en")))).alias("t"))
    shared = asked.join(own, "t").groupBy("qid", key).agg(F.count("*").cast("double").alias("score"))
    return top_k(shared, k, key)
