"""Retrieval, assembly, verification and evaluation over documents, chunks, golden items and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import assembly, retrieval, verification
from ..session import table, use_shared_checkpoints
from .text import sentences_sql, tokens_sql


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of all evaluation items, in every language."""
    items = table(spark, sf_dir, "golden_items").where("question is not null").groupBy(F.col("item_id").alias("qid"))
    return items.agg(F.min("question").alias("question"))


def _en_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings(_docs(spark, sf_dir), "doc_id")


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).agg(F.count("*").alias("n"))
    return retrieval.term_stats(_en_postings(spark, sf_dir), n).select("term", "df", F.round("idf", 6).alias("idf"))


def _best(docs: DataFrame, questions: DataFrame) -> DataFrame:
    return retrieval.bm25(docs, questions, "doc_id").select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def _normalised(docs: DataFrame, questions: DataFrame) -> DataFrame:
    best = F.max("score").over(Window.partitionBy("qid"))
    return retrieval.bm25(docs, questions, "doc_id", 8).select("qid", "doc_id", F.round(F.col("score") / best, 4).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(_docs(spark, sf_dir), _questions(spark, sf_dir))


def bm25_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(_docs(spark, sf_dir), _questions(spark, sf_dir))


def bm25_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(_docs(spark, sf_dir), _questions(spark, sf_dir))


def bm25_normalised_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(_docs(spark, sf_dir), _questions(spark, sf_dir))


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").groupBy("id").agg(F.min("text").alias("text"))
    return retrieval.hashed_vectors(chunks, "id").select("id", "bucket", (F.round("value", 6) + 0.0).alias("value"))


def hashed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = retrieval.hashed_vectors(_docs(spark, sf_dir), "doc_id")
    asked = retrieval.hashed_vectors(_questions(spark, sf_dir), "qid", "question")
    return retrieval.sparse_cosine(vectors, asked, "doc_id", 5).select("qid", "doc_id", F.round("score", 6).alias("score"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated question set: vectors whose id is divisible by 100."""
    return _vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return _vectors(spark, sf_dir).select("vec_id", F.round(F.sqrt(retrieval.dot(e, e)), 5).alias("norm"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.cosine_top_k(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), "vec_id", "embedding", 5)
    return found.select("qid", "vec_id", F.round("score", 5).alias("score"), "rank")


def maxsim_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are the labels; their patches are the vectors of the label."""
    asked = _asked_vectors(spark, sf_dir).select((F.col("qid") % 200).alias("qid"), F.col("qid").alias("token"), "q")
    patches = _vectors(spark, sf_dir).select(F.col("label").alias("page"), F.col("embedding").alias("vec"))
    return retrieval.max_sim(patches, asked, "page", 5).select("qid", "page", F.round("score", 5).alias("score"))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed vectors and BM25, eight of each, fused."""
    docs, questions = _docs(spark, sf_dir), _questions(spark, sf_dir)
    vectors = retrieval.hashed_vectors(docs, "doc_id")
    asked = retrieval.hashed_vectors(questions, "qid", "question")
    dense = retrieval.sparse_cosine(vectors, asked, "doc_id", 8)
    return retrieval.fuse([dense, retrieval.bm25(docs, questions, "doc_id", 8)], "doc_id", 5)


def rerank_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _vectors(spark, sf_dir).select(F.col("label").alias("qid"), "vec_id", (F.element_at("embedding", 1).cast("double") * F.when(F.col("label") % 2 == 0, 10).otherwise(0.001) + F.when(F.col("label") % 2 == 0, 0).otherwise(0.5)).alias("score"))
    return retrieval.squash(scores).select("qid", "vec_id", F.round("score", 5).alias("score"))


def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the catalogue whose name, brand and type share words with a question for each nation."""
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("Which parts are of the type and name "), "n_name", F.lit(" steel copper part?")).alias("question"))
    return retrieval.catalogue_lookup(table(spark, sf_dir, "part"), asked, "p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type")).select("qid", "p_partkey", "score", "rank")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a document as evidence for a question about it, in calls of four."""
    rows = table(spark, sf_dir, "chunks").select(F.col("doc_id").alias("qid"), "id", "text", "position").distinct()
    ordered = rows.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("position", "id", "text")))
    return ordered.select("qid", "id", "text", "ord", F.floor((F.col("ord") - 1) / 4).cast("int").alias("call_id"), F.col("ord").alias("rank"), (1.0 / F.col("ord")).alias("score"))


def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.dedupe(_evidence(spark, sf_dir)).select("qid", "id", "ord", F.round("score", 6).alias("score"))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.fuse_calls(assembly.dedupe(_evidence(spark, sf_dir))).select("qid", "id", "ord", "fused_score")


def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.pack(assembly.fuse_calls(assembly.dedupe(_evidence(spark, sf_dir)))).select("qid", "marker", "id", "cost")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item answered from the sentences of its own passage: the source of marker 1; its question is marker 2."""
    items = table(spark, sf_dir, "golden_items").groupBy(F.col("item_id").alias("qid")).agg(F.min("question").alias("question"), F.min("passage").alias("passage"), F.min("category").alias("category"), F.min("expected_substrings").alias("expected_substrings"))
    return items


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _answers(spark, sf_dir)
    return items.select("qid", F.posexplode(F.array("passage", "question")).alias("m", "text")).select("qid", (F.col("m") + 1).alias("marker"), "text")


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _answers(spark, sf_dir)
    made = F.concat(F.regexp_replace("passage", r"\.( |$)", " [1].$1"), F.lit(" Nobody has ever counted wooden elephants [2]. [1]"))
    # some answers abstain, some are empty
    answer = F.when(F.col("qid") % 11 == 0, verification.INSUFFICIENT).when(F.col("qid") % 13 == 0, "").otherwise(made)
    return items.select("qid", "question", "category", "expected_substrings", answer.alias("answer"))


def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.citations(_answered(spark, sf_dir))


def claim_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.split_claims(_answered(spark, sf_dir)).withColumn("cited", F.array_join("cited", ","))


def lexical_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verification.support(verification.split_claims(_answered(spark, sf_dir)), _sources(spark, sf_dir))
    return found.select("qid", "claim_no", F.round("best", 6).alias("best"), "supported")


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = verification.split_claims(_answered(spark, sf_dir))
    return verification.report(_answered(spark, sf_dir), claims, verification.support(claims, _sources(spark, sf_dir)))


def judge_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answered(spark, sf_dir)
    claims = verification.split_claims(answers)
    return verification.judge(answers, claims, _sources(spark, sf_dir))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.summarise(verification.score_items(_answered(spark, sf_dir)))


def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = _sources(spark, sf_dir).where("marker = 1")
    return verification.extract_answers(_answers(spark, sf_dir).select("qid", "question"), passages)


def retrieved_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: hybrid retrieval, an extracted answer from the best three documents, and its check."""
    use_shared_checkpoints(spark)
    # the best documents and the answers are small and read several times: retrieval runs once
    best = hybrid_rrf(spark, sf_dir).where("rank <= 3").checkpoint()
    sources = best.join(_docs(spark, sf_dir), "doc_id").select("qid", F.col("rank").alias("marker"), "text")
    answers = verification.extract_answers(_questions(spark, sf_dir), sources).checkpoint()
    claims = verification.split_claims(answers)
    return answers.join(verification.report(answers, claims, verification.support(claims, sources)), "qid", "left")


# ---- the same in SQL
_ASKED = "SELECT item_id AS qid, min(question) AS question FROM golden_items WHERE question IS NOT NULL GROUP BY item_id"

QUERIES = {
    f.__name__: f
    for f in (
        term_stats, bm25_topk, bm25_topk_all, bm25_normalised, bm25_normalised_all, hash_embed, hashed_search, l2_norm, cosine_topk, maxsim_rank, hybrid_rrf, rerank_squash, catalog_lookup,
        evidence_dedup, rrf_fuse, greedy_pack, citation_extract, claim_split, lexical_support, verify_report, judge_lexical, eval_summary, extractive_answer, retrieved_answers,
    )
}


def _tokens_by_language(x: str, language: str) -> str:
    from ..functions import lang
    from .text import raw_tokens_sql

    stop = " ".join(f"WHEN '{code}' THEN list_contains([{', '.join(repr(w) for w in lang.STOPWORDS[code])}], t)" for code in ("de", "ar", "ur"))
    english = ", ".join(repr(w) for w in lang.STOPWORDS["en"])
    return (
        f"list_filter({raw_tokens_sql(x)}, lambda t: CASE WHEN regexp_matches(t, '^[{lang.CJK}]') THEN NOT regexp_matches(t, '^[{lang.CHINESE_STOP_CHARS}]+$') "
        f"ELSE length(t) > 1 AND NOT CASE {language} {stop} WHEN 'zh' THEN false ELSE list_contains([{english}], t) END END)"
    )


def _language_cte(source: str, key: str, x: str) -> str:
    from .text import _LANG_SQL

    return _LANG_SQL.replace("FROM documents", f"FROM (SELECT {key} AS doc_id, {x} AS text FROM {source}) src")


def _token_ctes(name: str, source: str, key: str, x: str) -> str:
    """CTE `name`: key, toks."""
    return f"{name}_lang AS ({_language_cte(source, key, x)}), {name} AS (SELECT s.{key}, {_tokens_by_language('s.' + x, 'l.language')} AS toks FROM {source} s JOIN {name}_lang l ON l.doc_id = s.{key})"


_BM25 = f"""
WITH asked AS ({_ASKED}), {_token_ctes('dt', 'documents', 'doc_id', 'text')}, {_token_ctes('qt', 'asked', 'qid', 'question')},
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM dt),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS doc_len FROM (SELECT doc_id, len(toks) AS n, unnest(toks) AS term FROM dt) x GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(toks) AS term FROM qt) x GROUP BY qid, term),
s AS (SELECT q.qid, p.doc_id, round(sum(q.qtf * ln(1 + (stats.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.doc_len / stats.avg_len))), 9) AS score
      FROM q JOIN df USING (term) JOIN post p USING (term), stats GROUP BY q.qid, p.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
"""


def _vectors_sql(name: str, source: str, key: str, x: str) -> str:
    """CTE `name`: key, bucket, value of hashed vectors."""
    triples = "list_transform(range(1, length(t) - 1), lambda i: 'cg:' || substr(t, i, 3))"
    return f"""{_token_ctes(name + "_t", source, key, x)},
{name}_f AS (SELECT {key}, unnest(CASE WHEN length(t) >= 5 THEN list_concat([t], {triples}) ELSE [t] END) AS feature FROM (SELECT {key}, unnest(toks) AS t FROM {name}_t) y),
{name}_w AS (SELECT {key}, feature, (1 + ln(count(*))) * CASE WHEN feature LIKE 'cg:%' THEN 0.4::DOUBLE ELSE 1 END AS weight FROM {name}_f GROUP BY {key}, feature),
{name}_b AS (SELECT {key}, CAST(('0x' || substr(md5(feature), 1, 8))::BIGINT % 768 AS INT) AS bucket, sum(weight * CASE WHEN ('0x' || substr(md5(feature), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM {name}_w GROUP BY 1, 2),
{name} AS (SELECT {key}, bucket, v / CASE WHEN n = 0 THEN 1 ELSE n END AS value FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS n FROM {name}_b) z)"""


_HASHED = f"""
WITH asked AS ({_ASKED}), {_vectors_sql("dv", "documents", "doc_id", "text")}, {_vectors_sql("qv", "asked", "qid", "question")},
hs AS (SELECT qv.qid, dv.doc_id, round(sum(qv.value * dv.value), 9) AS score FROM qv JOIN dv USING (bucket) GROUP BY ALL),
hr AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM hs)
"""
_HYBRID = f"""
WITH h AS ({_HASHED} SELECT qid, doc_id, rank FROM hr WHERE rank <= 8), b AS ({_BM25} SELECT qid, doc_id, rank FROM r WHERE rank <= 8),
l AS (SELECT qid, doc_id, rank - 1 AS place, 0 AS source FROM h UNION ALL SELECT qid, doc_id, rank - 1, 1 FROM b),
f AS (SELECT qid, doc_id, sum(1.0::DOUBLE / ({retrieval.RRF_K} + place)) AS score, min(source * 100000 + place) AS first FROM l GROUP BY qid, doc_id),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS INT) AS rank FROM f)
SELECT qid, doc_id, round(score / max(score) OVER (PARTITION BY qid), 4) AS score, rank FROM o WHERE rank <= 5
"""
_DOT = "list_sum(list_transform(list_zip(q, embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_EVIDENCE = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY position, id, text) AS ord FROM (SELECT DISTINCT doc_id AS qid, id, text, position FROM chunks) c),
e AS (SELECT qid, id, text, ord, (ord - 1) // 4 AS call_id, 1.0::DOUBLE / ord AS score, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS hash FROM o),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, hash ORDER BY ord) AS n, max(score) OVER (PARTITION BY qid, hash) AS best FROM e) x WHERE n = 1),
f AS (SELECT *, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY qid, call_id ORDER BY ord) - 1) AS rrf FROM d),
g AS (SELECT qid, id, CAST(ord AS INT) AS ord, text, round(0.6::DOUBLE * (best + 1) / 2 + 0.4::DOUBLE * (rrf / max(rrf) OVER (PARTITION BY qid)), 4) AS fused_score, best FROM f)
"""
_ANSWERED = f"""
WITH items AS (SELECT item_id AS qid, min(question) AS question, min(passage) AS passage, min(category) AS category, min(expected_substrings) AS expected FROM golden_items GROUP BY item_id),
a AS (SELECT *, CASE WHEN qid % 11 = 0 THEN '{verification.INSUFFICIENT}' WHEN qid % 13 = 0 THEN '' ELSE regexp_replace(passage, '\\.( |$)', ' [1].\\1', 'g') || ' Nobody has ever counted wooden elephants [2]. [1]' END AS answer FROM items)
"""
_CLAIMS = _ANSWERED + f"""
, raws AS (SELECT qid, unnest(ss) AS raw, generate_subscripts(ss, 1) AS pos FROM (SELECT qid, {sentences_sql('answer')} AS ss FROM a WHERE answer <> '') x),
pieces AS (SELECT qid, pos, trim(regexp_replace(regexp_replace(raw, '\\[\\d{{1,2}}\\]', '', 'g'), '\\s+', ' ', 'g')) AS claim, list_transform(regexp_extract_all(raw, '\\[(\\d{{1,2}})\\]', 1), lambda x: CAST(x AS INT)) AS marks FROM raws),
counted AS (SELECT *, length(claim) >= 3 AS whole, sum(CASE WHEN length(claim) >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY pos) AS claim_no FROM pieces),
claims AS (SELECT qid, CAST(claim_no AS BIGINT) AS claim_no, max(CASE WHEN whole THEN claim END) AS claim, list_sort(list_distinct(flatten(list(marks)))) AS cited FROM counted WHERE claim_no > 0 GROUP BY ALL)
"""
_SUPPORT = _CLAIMS + f"""
, ck AS (SELECT qid * 1000 + claim_no AS key, qid, claim_no, cited, claim FROM claims), {_token_ctes('ct', 'ck', 'key', 'claim')},
sk AS (SELECT qid * 10 + 1 AS key, qid, 1 AS marker, passage AS text FROM items UNION ALL SELECT qid * 10 + 2, qid, 2, question FROM items), {_token_ctes('st', 'sk', 'key', 'text')},
cw AS (SELECT ck.*, list_distinct(ct.toks) AS words FROM ck JOIN ct ON ct.key = ck.key), sw AS (SELECT sk.qid, sk.marker, list_distinct(st.toks) AS words FROM sk JOIN st ON st.key = sk.key),
met AS (SELECT cw.qid, cw.claim_no, cw.cited, len(cw.words) AS n, s.marker, coalesce(list_contains(cw.cited, s.marker), false) AS cites, len(list_intersect(cw.words, s.words)) AS shared FROM cw LEFT JOIN sw s ON s.qid = cw.qid),
pool AS (SELECT *, bool_or(cites) OVER (PARTITION BY qid, claim_no) AS any_cited FROM met),
support AS (SELECT qid, claim_no, any_value(cited) AS cited, max(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE coalesce(shared / n, 0) END) AS best FROM pool WHERE cites OR NOT any_cited GROUP BY qid, claim_no)
"""
SQL = {
    "claim_split": _CLAIMS + "SELECT qid, claim_no, claim, array_to_string(cited, ',') AS cited FROM claims",
    "lexical_support": _SUPPORT + f"SELECT qid, claim_no, round(best, 6) AS best, best >= {verification.SUPPORT} AS supported FROM support",
    "verify_report": _SUPPORT
    + f"""
, per AS (SELECT qid, count(*) AS n, round(avg(CASE WHEN best >= {verification.SUPPORT} THEN 1.0::DOUBLE ELSE 0 END), 3) AS grounded, round(avg(CASE WHEN len(cited) > 0 THEN 1.0::DOUBLE ELSE 0 END), 3) AS cites FROM support GROUP BY qid),
r AS (SELECT a.qid, trim(a.answer) = '{verification.INSUFFICIENT}' AS abstains, per.* EXCLUDE (qid) FROM a LEFT JOIN per ON per.qid = a.qid),
v AS (SELECT qid, abstains, CASE WHEN abstains THEN 0 ELSE coalesce(n, 0) END AS n_claims, CASE WHEN abstains THEN 1.0::DOUBLE ELSE coalesce(grounded, 0) END AS groundedness, CASE WHEN abstains THEN 1.0::DOUBLE ELSE coalesce(cites, 0) END AS coverage FROM r)
SELECT qid, n_claims, groundedness, coverage, abstains OR (groundedness >= {verification.PASS_GROUNDED} AND coverage >= {verification.PASS_COVERED}) AS passed FROM v""",
    "judge_lexical": _SUPPORT
    + f"""
, best AS (SELECT qid, claim_no, max(shared / n) AS b FROM met WHERE n > 0 GROUP BY qid, claim_no), faith AS (SELECT qid, round(avg(b), 3) AS f FROM best GROUP BY qid),
qk AS (SELECT qid, question FROM a), {_token_ctes('qq', 'qk', 'qid', 'question')}, ak AS (SELECT qid, answer FROM a), {_token_ctes('aa', 'ak', 'qid', 'answer')},
rel AS (SELECT a.qid, a.answer, CASE WHEN len(list_distinct(q.toks)) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(list_distinct(q.toks), list_distinct(w.toks))) / len(list_distinct(q.toks)), 3) END AS r FROM a JOIN qq q ON q.qid = a.qid JOIN aa w ON w.qid = a.qid)
SELECT rel.qid, CASE WHEN trim(answer) = '{verification.INSUFFICIENT}' THEN 1.0::DOUBLE WHEN c.qid IS NULL THEN 0 ELSE coalesce(f.f, 0) END AS faithfulness,
  CASE WHEN trim(answer) = '{verification.INSUFFICIENT}' THEN 1.0::DOUBLE WHEN c.qid IS NULL THEN 0 ELSE rel.r END AS relevance
FROM rel LEFT JOIN (SELECT DISTINCT qid FROM claims) c ON c.qid = rel.qid LEFT JOIN faith f ON f.qid = rel.qid""",
    "extractive_answer": _ANSWERED
    + f"""
, qk AS (SELECT qid, question FROM items), {_token_ctes('qq', 'qk', 'qid', 'question')},
said AS (SELECT qid, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos FROM (SELECT qid, {sentences_sql('passage')} AS ss FROM items) x),
sk AS (SELECT qid * 10000 + pos AS key, qid, pos, sentence FROM said), {_token_ctes('st', 'sk', 'key', 'sentence')},
met AS (SELECT s.qid, s.pos, s.sentence, len(list_intersect(list_distinct(q.toks), list_distinct(t.toks))) AS n FROM sk s JOIN st t ON t.key = s.key JOIN qq q ON q.qid = s.qid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, pos) AS place FROM met WHERE n > 0),
one AS (SELECT * FROM ranked WHERE place = 1),
two AS (SELECT r.qid, arg_min(r.sentence, r.place) AS sentence FROM ranked r JOIN one o ON o.qid = r.qid WHERE r.place > 1 AND r.n >= greatest(2, o.n - 1) AND r.sentence <> o.sentence AND r.n = o.n GROUP BY r.qid)
SELECT o.qid, o.sentence || ' [1]' || CASE WHEN t.sentence IS NULL THEN '' ELSE ' ' || t.sentence || ' [1]' END AS answer FROM one o LEFT JOIN two t ON t.qid = o.qid""",
    "greedy_pack": _EVIDENCE.replace("WITH o AS", "WITH RECURSIVE o AS")
    + f"""
, p AS (SELECT qid, id, text, ord, greatest(1, length(text) // 4) AS cost, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, ord) AS k FROM g),
w AS (SELECT qid, 0 AS k, 0 AS used, 0 AS picked, false AS fits FROM (SELECT DISTINCT qid FROM p) q UNION ALL
  SELECT qid, k, used + CASE WHEN ok THEN cost ELSE 0 END, picked + CASE WHEN ok THEN 1 ELSE 0 END, ok FROM (
    SELECT w.qid, p.k, w.used, w.picked, p.cost, w.picked < {assembly.MOST_SOURCES} AND (w.picked = 0 OR w.used + p.cost <= {assembly.BUDGET}) AS ok FROM w JOIN p ON p.qid = w.qid AND p.k = w.k + 1) x)
SELECT w.qid, CAST(w.picked AS INT) AS marker, p.id, CAST(p.cost AS INT) AS cost FROM w JOIN p ON p.qid = w.qid AND p.k = w.k WHERE w.fits""",
    "term_stats": f"WITH {_token_ctes('dt', 'documents', 'doc_id', 'text')}, p AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM dt), c AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p, c GROUP BY term",
    "bm25_topk": _BM25 + "SELECT qid, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5",
    "bm25_topk_all": _BM25 + "SELECT qid, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5",
    "bm25_normalised_all": _BM25 + "SELECT qid, doc_id, round(score / max(score) OVER (PARTITION BY qid), 4) AS score FROM r WHERE rank <= 8",
    "hashed_search": _HASHED + "SELECT qid, doc_id, round(score, 6) AS score FROM hr WHERE rank <= 5",
    "hybrid_rrf": _HYBRID,
    "bm25_normalised": _BM25 + "SELECT qid, doc_id, round(score / max(score) OVER (PARTITION BY qid), 4) AS score FROM r WHERE rank <= 8",
    "l2_norm": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings",
    "cosine_topk": f"WITH a AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT qid, vec_id, {_DOT} AS score FROM embeddings, a), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT qid, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 5",
    "maxsim_rank": f"WITH a AS (SELECT vec_id % 200 AS qid, vec_id AS token, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT qid, token, label AS page, max({_DOT}) AS s FROM embeddings, a GROUP BY qid, token, label), t AS (SELECT qid, page, sum(s) AS score FROM s GROUP BY qid, page), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page) AS rank FROM t) SELECT qid, page, round(score, 5) AS score FROM r WHERE rank <= 5",
    "rerank_squash": "WITH s AS (SELECT label AS qid, vec_id, CAST(embedding[1] AS DOUBLE) * CASE WHEN label % 2 = 0 THEN 10 ELSE 0.001::DOUBLE END + CASE WHEN label % 2 = 0 THEN 0 ELSE 0.5::DOUBLE END AS score FROM embeddings), o AS (SELECT *, bool_or(score < 0 OR score > 1) OVER (PARTITION BY qid) AS outside FROM s) SELECT qid, vec_id, round(CASE WHEN outside THEN 1 / (1 + exp(-score)) ELSE score END, 5) AS score FROM o",
    "catalog_lookup": f"WITH own AS (SELECT p_partkey, unnest(list_distinct({tokens_sql('concat_ws(chr(32), p_name, p_brand, p_type)')})) AS t FROM part), a AS (SELECT n_nationkey AS qid, unnest(list_distinct({tokens_sql(chr(39) + 'Which parts are of the type and name ' + chr(39) + ' || n_name || ' + chr(39) + ' steel copper part?' + chr(39))})) AS t FROM nation), s AS (SELECT qid, p_partkey, CAST(count(*) AS DOUBLE) AS score FROM a JOIN own USING (t) GROUP BY qid, p_partkey), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, p_partkey) AS INT) AS rank FROM s) SELECT qid, p_partkey, score, rank FROM r WHERE rank <= 3",
    "evidence_dedup": _EVIDENCE + "SELECT qid, id, CAST(ord AS INT) AS ord, round(best, 6) AS score FROM d",
    "rrf_fuse": _EVIDENCE + "SELECT qid, id, ord, fused_score FROM g",
    "citation_extract": _ANSWERED + ", m AS (SELECT qid, list_transform(regexp_extract_all(answer, '\\[(\\d{1,2})\\]', 1), lambda x: CAST(x AS INT)) AS ms FROM a), u AS (SELECT qid, unnest(ms) AS marker, generate_subscripts(ms, 1) AS pos FROM m), f AS (SELECT qid, marker, min(pos) AS first FROM u GROUP BY qid, marker) SELECT qid, marker, CAST(row_number() OVER (PARTITION BY qid ORDER BY first) - 1 AS INT) AS place FROM f",
    "eval_summary": _ANSWERED + ", s AS (SELECT coalesce(category, 'none') AS category, len(list_filter(expected, lambda x: NOT contains(lower(answer), lower(x)))) = 0 AS correct, regexp_matches(answer, '\\[\\d{1,2}\\]') AS cited FROM a) SELECT category, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct, count(*) FILTER (WHERE cited) AS n_cited, round(count(*) FILTER (WHERE correct) / count(*), 4) AS pass_rate FROM s GROUP BY category",
    "hash_embed": f"WITH one AS (SELECT id, min(text) AS text FROM chunks GROUP BY id), {_token_ctes('dt', 'one', 'id', 'text')}, t AS (SELECT id, unnest(toks) AS t FROM dt), f AS (SELECT id, unnest(CASE WHEN length(t) >= 5 THEN list_concat([t], list_transform(range(1, length(t) - 1), lambda i: 'cg:' || substr(t, i, 3))) ELSE [t] END) AS feature FROM t), w AS (SELECT id, feature, (1 + ln(count(*))) * CASE WHEN feature LIKE 'cg:%' THEN 0.4::DOUBLE ELSE 1 END AS weight FROM f GROUP BY id, feature), b AS (SELECT id, CAST(('0x' || substr(md5(feature), 1, 8))::BIGINT % 768 AS INT) AS bucket, sum(weight * CASE WHEN ('0x' || substr(md5(feature), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2) SELECT id, bucket, round(v / CASE WHEN n = 0 THEN 1 ELSE n END, 6) + 0.0::DOUBLE AS value FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY id)) AS n FROM b) x",
}
