"""Queries over the entity graph, routing of questions, and streams of events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.normalize import ascii_normal_name, normal_key_udf
from ..functions.text import content_tokens
from ..operators import extraction, graph
from ..operators.relational import arithmetic_udf
from ..session import shared_folder, table, use_shared_checkpoints
from ..streaming import events as streams
from .orphans import _key_sql


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distinct_edges(table(spark, sf_dir, "edges"))


def kg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "entities").groupBy(F.lit("entity").alias("kind"), "type").agg(F.countDistinct("id").alias("n"))
    return entities.unionByName(table(spark, sf_dir, "edges").groupBy(F.lit("edge").alias("kind"), "type").agg(F.countDistinct("edge_id").alias("n")))


def kg_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every third document extracted anew (their sentence cut at 500), one row per key."""
    edges = table(spark, sf_dir, "edges")
    again = edges.where("doc_id % 3 = 0").withColumn("edge_id", F.col("edge_id") + 10_000_000).withColumn("sentence", F.substring("sentence", 1, 500))
    return graph.distinct_edges(graph.replace_documents(edges, again)).select("edge_id", "source_id", "target_id", "type", "chunk_id")


def kg_edge_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_domain(_edges(spark, sf_dir)).select("edge_id", "source_id", "target_id", "type")


def kg_used_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.used_entities(table(spark, sf_dir, "entities"), table(spark, sf_dir, "mentions"), table(spark, sf_dir, "edges")).select("id", "entity_no").distinct()


def kg_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.both_ways(_edges(spark, sf_dir)).groupBy("node", "type", "is_source").agg(F.countDistinct("neighbour").alias("n_neighbours"))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated questions: one for each entity whose number is divisible by 100."""
    return table(spark, sf_dir, "entities").where("entity_no % 100 = 0").select(F.col("entity_no").alias("qid"), F.col("id").alias("node")).distinct()


def kg_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk(table(spark, sf_dir, "edges"), _seeds(spark, sf_dir), 3)


def _walk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seeds = _seeds(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("node")))
    return graph.breadth_first(_edges(spark, sf_dir), seeds, 2)


def kg_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that a walk of two hops and forty nodes meets."""
    return _walk(spark, sf_dir)[0].select("qid", "source_id", "target_id", "type", "hop")


def kg_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir)[1]


def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question the six chunks that a walk from the entities it names leads to, with their texts."""
    use_shared_checkpoints(spark)
    links = seed_link_questions(spark, sf_dir).checkpoint()
    seeds = graph.best_seeds(links, table(spark, sf_dir, "entities"))
    steps, reached = graph.breadth_first(_edges(spark, sf_dir), seeds)
    found = graph.walked_chunks(steps, reached, table(spark, sf_dir, "mentions"))
    texts = table(spark, sf_dir, "chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.min("text").alias("text"))
    return found.join(texts, "chunk_id").select("qid", "place", "chunk_id", "text")


def best_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight entities with the longest names of those that a question names."""
    return graph.best_seeds(seed_link_questions(spark, sf_dir), table(spark, sf_dir, "entities"))


def kg_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.path_lines(graph.walk(table(spark, sf_dir, "edges"), _seeds(spark, sf_dir), 2))


def kg_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "mentions").join(_seeds(spark, sf_dir), F.col("entity_id") == F.col("node"))
    return found.select("qid", "chunk_id").distinct().join(table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").select("qid", "chunk_id")


def kg_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations read again from the sentences, between the two ends that the edges name."""
    edges = _edges(spark, sf_dir).where("sentence is not null")
    ends = edges.select("edge_id", "sentence", F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    ends = ends.withColumn("type", F.split_part("entity_id", F.lit(":"), F.lit(1))).withColumn("name", F.expr("substring(entity_id, length(type) + 2)"))
    at = F.expr("locate(name, lower(sentence))")
    mentions = ends.withColumn("at", at).where("at > 0").select(F.col("edge_id").alias("sentence_id"), "entity_id", "type", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("name")).alias("end"))
    return graph.relations(mentions, edges.select(F.col("edge_id").alias("sentence_id"), "sentence"))


def _chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), "text").distinct()
    rows = rows.select("chunk_id", F.posexplode(text.split_sentences(F.col("text"))).alias("sentence_no", "sentence"))
    return rows.withColumn("sentence_id", F.concat_ws("/", "chunk_id", "sentence_no"))


def kg_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mentions that the rules find in the sentences of all chunks, of at most twelve entities a chunk."""
    sentences = _chunk_sentences(spark, sf_dir)
    found = extraction.extract_mentions(sentences)
    place = F.regexp_extract("sentence_id", r"^(.*)/(\d+)$", 1).alias("chunk_id"), F.regexp_extract("sentence_id", r"/(\d+)$", 1).cast("int").alias("sentence_no")
    return extraction.cap_entities(found.select(*place, "entity_id", "name", "type", "start", "end").distinct())


def kg_extract_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations between the mentions that the rules find in the stored sentences of edges."""
    sentences = table(spark, sf_dir, "edges").where("sentence is not null").select(F.md5("sentence").alias("sentence_id"), "sentence").distinct()
    return extraction.extract_relations(sentences, extraction.extract_mentions(sentences))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name: what each entity is called, by itself and where it is mentioned."""
    entities = table(spark, sf_dir, "entities").select("id", "name").distinct()
    keys = entities.select("id", normal_key_udf("id").alias("key")).distinct()
    surfaces = table(spark, sf_dir, "mentions").where("entity_id is not null").select("entity_id", F.col("surface").alias("name")).distinct()
    surfaces = surfaces.withColumn("key", normal_key_udf("entity_id")).join(keys, "key")
    return entities.unionByName(surfaces.select("id", "name"))


def seed_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that a document names in full, by their name or a surface that mentions record."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return graph.link_names(documents, "doc_id", "text", _names(spark, sf_dir))


def seed_link_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the questions of the evaluation items."""
    return graph.link_names(_questions(spark, sf_dir), "qid", "question", _names(spark, sf_dir))


def kg_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as references write them, by the rule in Python, beside the rule inside the JVM where the key is ASCII."""
    rows = table(spark, sf_dir, "mentions").where("entity_id is not null").select("entity_id").distinct()
    rest = F.expr("substring(entity_id, length(split_part(entity_id, ':', 1)) + 2)")
    both = rows.select("entity_id", normal_key_udf("entity_id").alias("key"), F.when(rest.rlike("^[ -~]*$"), F.concat(F.split_part("entity_id", F.lit(":"), F.lit(1)), F.lit(":"), ascii_normal_name(rest))).alias("ascii_key"))
    return both.select("entity_id", "key", F.coalesce(F.col("ascii_key") == F.col("key"), F.lit(True)).alias("agrees"))


# ---- questions

# Phrases that send a question to a tool, in order of precedence.
GRAPH_HINTS = ["the company that", "the company behind", "the company which", "made by the", "built by the", "manufactured by the", "whose", "which company", "who makes", "who manufactures", "headquartered in", "supplier", "supply chain", "connected to", "related to", "the maker of", "the manufacturer of", "from the company", "same company"]
KB_HINTS = ["price", "cost", "plan", "sku", "catalog", "lease", "metric", "deployed", "how much"]


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "golden_items").select(F.col("item_id").alias("qid"), "question").distinct()


def route_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.lower("question")
    hit = lambda hints: F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(q, h))
    tool = F.when(expression_of(F.col("question")).isNotNull(), "calculator").when(hit(GRAPH_HINTS), "graph_search").when(hit(KB_HINTS), "knowledge_base").otherwise("vector_search")
    return _questions(spark, sf_dir).select("qid", tool.alias("tool")).distinct()


#: Characters and content words that either half of a question needs.
HALF_CHARS, HALF_WORDS = 20, 3


def decompose_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in two at their first ` and `, when both halves are long enough to stand alone."""
    q = F.col("question")
    at = F.locate(" and ", F.lower(q))
    ends = lambda c: F.regexp_replace(c, "^[ ,]+|[ ,]+$", "")
    halves = [ends(F.substring(q, F.lit(1), at - 1)), ends(F.substring(q, at + 5, F.length(q)))]
    split = at > 0
    for half in halves:
        split = split & (F.length(half) >= HALF_CHARS) & (F.size(content_tokens(half)) >= HALF_WORDS)
    asked = F.array(*[F.when(half.endswith("?"), half).otherwise(F.concat(half, F.lit("?"))) for half in halves])
    return _questions(spark, sf_dir).select("qid", F.posexplode(F.when(split, asked).otherwise(F.array(q))).alias("branch", "part")).distinct()


# Words that introduce a name made of figures.
IDENTIFIER_WORDS = "iso iec en din ansi ieee soc rfc sku version v model part standard type no rev revision chapter section clause annex".split()


def expression_of(question: Column) -> Column:
    """The arithmetic that a question asks for, or null: figures joined by operators, or a share of a number.

    Figures that touch letters or marks of an identifier are a name, and so are spans of years, and
    figures joined by a bare hyphen in a question with a word that introduces identifiers.
    """
    number, operator = r"\d[\d.,]{0,20}", r"\s{0,3}[-+*/x×]\s{0,3}"
    bare = F.regexp_replace(question, r"(?<=\d),(?=\d{3})", "")
    share = rf"(?i)({number})\s{{0,3}}%\s{{0,3}}of\s{{1,3}}({number})"
    figure = r"[(]{0,3}\d+(?:\.\d+)?[)]{0,3}"
    chain = F.regexp_extract(bare, rf"(?<![\p{{L}}\d:./-]){figure}(?:{operator}{figure}){{1,20}}(?![\p{{L}}\d:/-]|\.\d)", 0)
    years = chain.rlike(r"^(?:19|20)\d{2}\s*-\s*(?:19|20)\d{2}$")
    words = F.split(F.regexp_replace(F.lower(question), r"[.,:;?()]", ""), r"\s+")
    named = chain.rlike(r"\d-\d") & F.arrays_overlap(words, F.array(*[F.lit(w) for w in IDENTIFIER_WORDS]))
    part = lambda k: F.regexp_extract(bare, share, k)
    return F.when(part(1) != "", F.concat(part(2), F.lit(" * "), part(1), F.lit(" / 100"))).when((chain != "") & ~years & ~named, F.translate(chain, "x×", "**"))


def calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the questions and passages of the items, and the texts of the chunks, ask to be computed, with the value."""
    items = table(spark, sf_dir, "golden_items").select(F.explode(F.array("question", "passage")).alias("text"))
    texts = items.unionByName(table(spark, sf_dir, "chunks").select("text")).where("text is not null")
    found = texts.select(expression_of(F.col("text")).alias("expression")).where("expression is not null").groupBy("expression").agg(F.count("*").alias("n"))
    return found.select("expression", "n", arithmetic_udf("expression").alias("value"))


# ---- events


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(_events(spark, sf_dir))


def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sliding(_events(spark, sf_dir))


def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(_events(spark, sf_dir))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling windows once more, by a stream over the file."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event*.parquet")
    return streams.drain(streams.tumbling(stream), f"{shared_folder(spark)}/events-{uuid.uuid4().hex}")


def step_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _events(spark, sf_dir).select(F.col("user_id").alias("qid"), "ts", F.col("event_id").alias("step_id"))
    return streams.within_budget(steps, 12).groupBy("qid").agg(F.count("*").alias("n_steps"), F.max("step_id").alias("last_step"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ingested by a stream, twice: the second run adds nothing."""
    home = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    source = f"{home}/in"
    table(spark, sf_dir, "documents").select("doc_id", "text").write.mode("overwrite").parquet(source)
    for _ in range(2):
        streams.incremental_ingest(spark, source, f"{home}/out", f"{home}/checkpoint")
    return spark.read.parquet(f"{home}/out").select("doc_id", F.md5("text").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        kg_stats, kg_upsert, kg_edge_domain, kg_used_entities, kg_neighbours, kg_walk, kg_bfs, kg_reached, graph_search, best_seeds, kg_paths, kg_chunks, kg_relations, kg_extract, kg_extract_relations, seed_link, seed_link_questions, kg_normalize, route_tool, decompose_split, calculations,
        events_tumbling, events_sliding, events_sessions, events_stream, step_budget, stream_ingest,
    )
}

_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, type, chunk_id ORDER BY seen_at DESC, edge_id DESC) AS n FROM {} WHERE source_id IS NOT NULL AND target_id IS NOT NULL) x WHERE n = 1"
_E = _LAST.format("edges")


def _decompose_sql() -> str:
    from .retrieval import _token_ctes

    return f"""
WITH q AS (SELECT DISTINCT item_id AS qid, question, strpos(lower(question), ' and ') AS pos FROM golden_items WHERE question IS NOT NULL),
h AS (SELECT qid, question, pos, trim(substr(question, 1, pos - 1), ' ,') AS l, trim(substr(question, pos + 5), ' ,') AS r FROM q),
n AS (SELECT *, row_number() OVER (ORDER BY qid, question) AS key FROM h), {_token_ctes('lt', 'n', 'key', 'l')}, {_token_ctes('rt', 'n', 'key', 'r')},
s AS (SELECT n.*, pos > 0 AND length(l) >= {HALF_CHARS} AND length(r) >= {HALF_CHARS} AND len(list_distinct(lt.toks)) >= {HALF_WORDS} AND len(list_distinct(rt.toks)) >= {HALF_WORDS} AS split FROM n JOIN lt ON lt.key = n.key JOIN rt ON rt.key = n.key)
SELECT qid, 0 AS branch, CASE WHEN split THEN rtrim(l, '?') || '?' ELSE question END AS part FROM s UNION SELECT qid, 1, rtrim(r, '?') || '?' FROM s WHERE split"""


_FOLD = "replace(lower({}), 'ß', 'ss')".format
_SEEDS_SQL = f"""
WITH e AS (SELECT DISTINCT id, name FROM entities), k AS (SELECT DISTINCT id, {_key_sql('id')} AS key FROM e),
m AS (SELECT DISTINCT {_key_sql('entity_id')} AS key, surface FROM mentions WHERE entity_id IS NOT NULL),
names AS (SELECT id, {_FOLD('trim(name)')} AS name FROM e UNION SELECT k.id, {_FOLD('trim(m.surface)')} FROM m JOIN k ON k.key = m.key),
"""
_DOMAINS = ", ".join(f"('{t}', '{a}', '{b}')" for t, a, b in graph.DOMAINS)
_STEPS = "SELECT source_id AS node, target_id AS neighbour, source_id, target_id, type FROM d UNION ALL SELECT target_id, source_id, source_id, target_id, type FROM d"


def _walk_sql(hops: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT DISTINCT source_id, target_id, type FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL), s AS ({_STEPS}),
w AS (SELECT DISTINCT entity_no AS qid, id AS node, 0 AS hop FROM entities WHERE entity_no % 100 = 0 UNION SELECT w.qid, s.neighbour, w.hop + 1 FROM w JOIN s ON s.node = w.node WHERE w.hop < {hops - 1})
SELECT w.qid, s.source_id, s.target_id, s.type, CAST(min(w.hop + 1) AS INT) AS hop FROM w JOIN s ON s.node = w.node GROUP BY ALL"""


def _bfs_sql(hops: int, out: str) -> str:
    """The levels one after another: m met, n new, x expanded, f the next front."""
    levels, walked = [], []
    for k in range(1, hops + 1):
        levels.append(f"""
m{k} AS (SELECT f.qid, f.place, s.* FROM f{k - 1} f JOIN s ON s.node = f.node),
n{k} AS (SELECT qid, neighbour, place, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY qid, neighbour ORDER BY place, edge_id) AS rn FROM m{k} m WHERE NOT EXISTS (SELECT 1 FROM seen{k - 1} z WHERE z.qid = m.qid AND z.node = m.neighbour)) y WHERE rn = 1),
c{k} AS (SELECT f.qid, f.place, coalesce(c.n, 0) AS n, h.had FROM f{k - 1} f LEFT JOIN (SELECT qid, place, count(*) AS n FROM n{k} GROUP BY ALL) c ON c.qid = f.qid AND c.place = f.place JOIN (SELECT qid, count(*) AS had FROM seen{k - 1} GROUP BY qid) h ON h.qid = f.qid),
x{k} AS (SELECT qid, place FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c{k}) y WHERE before + had < {graph.MAX_NODES}),
f{k} AS (SELECT n.qid, n.neighbour AS node, CAST(row_number() OVER (PARTITION BY n.qid ORDER BY n.place, n.edge_id, n.neighbour) AS INT) AS place FROM n{k} n JOIN x{k} x ON x.qid = n.qid AND x.place = n.place),
seen{k} AS (SELECT * FROM seen{k - 1} UNION ALL SELECT qid, node, place, {k} FROM f{k})""")
        walked.append(f"SELECT m.qid, source_id, target_id, type, {k} AS hop FROM m{k} m JOIN x{k} x ON x.qid = m.qid AND x.place = m.place")
    return f"""
WITH e AS ({_E}), s AS (SELECT edge_id, source_id AS node, target_id AS neighbour, source_id, target_id, type FROM e UNION ALL SELECT edge_id, target_id, source_id, source_id, target_id, type FROM e),
f0 AS (SELECT qid, node, CAST(row_number() OVER (PARTITION BY qid ORDER BY node) AS INT) AS place FROM (SELECT DISTINCT entity_no AS qid, id AS node FROM entities WHERE entity_no % 100 = 0) d),
seen0 AS (SELECT qid, node, place, 0 AS hop FROM f0),{','.join(levels)}, w AS ({' UNION ALL '.join(walked)})
{out}"""


_STRIPPED = "lower(question)"
_ANY = lambda hints: "(" + " OR ".join(f"contains({_STRIPPED}, '{h}')" for h in hints) + ")"
SQL = {
    "kg_stats": "SELECT 'entity' AS kind, type, count(DISTINCT id) AS n FROM entities GROUP BY type UNION ALL SELECT 'edge', type, count(DISTINCT edge_id) FROM edges GROUP BY type",
    "kg_upsert": "WITH a AS (SELECT edge_id, source_id, target_id, type, chunk_id, seen_at FROM edges WHERE doc_id % 3 <> 0 OR doc_id IS NULL UNION ALL SELECT edge_id + 10000000, source_id, target_id, type, chunk_id, seen_at FROM edges WHERE doc_id % 3 = 0) SELECT edge_id, source_id, target_id, type, chunk_id FROM (" + _LAST.format("a") + ") y",
    "kg_edge_domain": f"WITH e AS ({_E}), dom(type, s, t) AS (VALUES {_DOMAINS}) SELECT edge_id, source_id, target_id, e.type FROM e WHERE EXISTS (SELECT 1 FROM dom WHERE dom.type = e.type AND dom.s = split_part(e.source_id, ':', 1) AND dom.t = split_part(e.target_id, ':', 1))",
    "kg_used_entities": "SELECT DISTINCT id, entity_no FROM entities WHERE id IN (SELECT entity_id FROM mentions WHERE entity_id IS NOT NULL UNION SELECT source_id FROM edges WHERE source_id IS NOT NULL UNION SELECT target_id FROM edges WHERE target_id IS NOT NULL)",
    "kg_neighbours": f"WITH e AS ({_E}), b AS (SELECT source_id AS node, target_id AS neighbour, type, true AS is_source FROM e UNION ALL SELECT target_id, source_id, type, false FROM e) SELECT node, type, is_source, count(DISTINCT neighbour) AS n_neighbours FROM b GROUP BY ALL",
    "kg_walk": _walk_sql(3),
    "decompose_split": _decompose_sql(),
    "seed_link": _SEEDS_SQL + f"t AS (SELECT doc_id, {_FOLD('text')} AS x FROM documents) SELECT DISTINCT t.doc_id, n.id FROM t JOIN names n ON n.name <> '' AND contains(t.x, n.name)",
    "seed_link_questions": _SEEDS_SQL + f"t AS (SELECT DISTINCT item_id AS qid, {_FOLD('question')} AS x FROM golden_items) SELECT DISTINCT t.qid, n.id FROM t JOIN names n ON n.name <> '' AND contains(t.x, n.name)",
    "kg_bfs": _bfs_sql(2, "SELECT qid, source_id, target_id, type, CAST(min(hop) AS INT) AS hop FROM w GROUP BY ALL"),
    "kg_reached": _bfs_sql(2, "SELECT qid, node, place, CAST(hop AS INT) AS hop FROM seen2"),
    "kg_paths": f"SELECT qid, 'hop ' || hop || ': ' || source_id || ' -[' || type || ']-> ' || target_id AS line FROM ({_walk_sql(2)}) w",
    "kg_chunks": "SELECT DISTINCT e.entity_no AS qid, m.chunk_id FROM mentions m JOIN entities e ON e.id = m.entity_id WHERE e.entity_no % 100 = 0 AND m.chunk_id IN (SELECT id FROM chunks)",
    "route_tool": f"SELECT DISTINCT item_id AS qid, CASE WHEN {_ANY(GRAPH_HINTS)} THEN 'graph_search' WHEN {_ANY(KB_HINTS)} THEN 'knowledge_base' ELSE 'vector_search' END AS tool FROM golden_items",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_sliding": "WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL (k) HOUR AS window_start, value FROM events, (VALUES (0), (1)) AS t(k)) SELECT window_start, count(*) AS n, round(max(value), 4) AS most FROM w GROUP BY ALL",
    "events_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, session",
    "step_budget": "SELECT user_id AS qid, count(*) AS n_steps, max(event_id) AS last_step FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) e WHERE n <= 12 GROUP BY user_id",
    "stream_ingest": "SELECT doc_id, md5(text) AS digest FROM documents",
}
SQL["events_stream"] = SQL["events_tumbling"]
