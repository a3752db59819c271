"""p1: references of sales_orders, mentions and edges to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normal_key_udf
from ..operators.orphans import key_numbers, orphan_references, orphan_report, runs_of
from ..session import table


def _ref(df: DataFrame, name: str, field: str, row_id: str, key: str, at: str) -> DataFrame:
    return df.select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(row_id).cast("long").alias("row_id"), F.col(key).alias("key"), F.col(at).alias("at"))


def customer_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "sales_orders").select("id", "customer_id", "loaded_at")
    first = orders.groupBy("id").agg(F.min("loaded_at").alias("loaded_at"), F.collect_set("customer_id").alias("customer_ids"))
    refs = _ref(first.withColumn("customer_id", F.explode("customer_ids")), "sales_orders", "customer_id", "id", "customer_id", "loaded_at")
    parents = table(spark, sf_dir, "customers").select(F.col("id").alias("key"), "created_at", "deleted_at")
    return orphan_references(refs, parents).withColumn("key", F.col("key").cast("string"))


def _entity_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "mentions")
    refs = _ref(mentions, "mentions", "entity_id", "mention_id", "entity_id", "seen_at")
    # both ends of an edge from one scan
    ends = F.explode(F.array(F.struct(F.lit("source_id").alias("field"), F.col("source_id").alias("id")), F.struct(F.lit("target_id").alias("field"), F.col("target_id").alias("id"))))
    edges = table(spark, sf_dir, "edges").select("edge_id", "seen_at", ends.alias("end"))
    return refs.unionByName(edges.select(F.lit("edges").alias("ref_table"), F.col("end.field").alias("ref_field"), F.col("edge_id").cast("long").alias("row_id"), F.col("end.id").alias("key"), F.col("seen_at").alias("at")))


def _entity_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").select(F.col("id").alias("key"), "created_at", "deleted_at")


def entity_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(_entity_references(spark, sf_dir), _entity_lives(spark, sf_dir), normal_key_udf)


def p1_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_orphans(spark, sf_dir).unionByName(entity_orphans(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_orphans(spark, sf_dir).select("ref_table", "ref_field", "row_id", "reason").distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p1_orphans(spark, sf_dir))


def _run_report(runs: DataFrame) -> DataFrame:
    length = F.col("run_end") - F.col("run_start") + 1
    return runs.groupBy("key_range").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.count("*").alias("n_runs"), F.sum(length).alias("n_keys"), F.max(length).alias("longest"))


def p1_customer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the runs of customer ids, against which the match is made, look like in each key range."""
    return _run_report(runs_of(table(spark, sf_dir, "customers").select(F.col("id").alias("k"))))


def p1_entity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for entity keys, by the number of the key among all keys of entities and references."""
    refs, lives = _entity_references(spark, sf_dir), _entity_lives(spark, sf_dir)
    return _run_report(runs_of(key_numbers(refs, lives, normal_key_udf)[1].where("is_parent")))


# Full-width forms, as NFKC folds them; written by rule.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + " 　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "  "


def _key_sql(c: str) -> str:
    rest = f"translate(nfc_normalize(substr({c}, strpos({c}, ':') + 1)), '{_WIDE}', '{_NARROW}')"
    cut = f"regexp_replace(regexp_replace({rest}, '^[\\s\"''(\\[,.;:]+', ''), '[\\s\"'')\\],.;:]+$', '')"
    return f"CASE WHEN strpos({c}, ':') = 0 THEN {c} ELSE split_part({c}, ':', 1) || ':' || replace(lower(trim(regexp_replace({cut}, '\\s+', ' ', 'g'))), 'ß', 'ss') END"


_ORPHANS_SQL = f"""
WITH refs AS (
  SELECT 'sales_orders' AS ref_table, 'customer_id' AS ref_field, o.id AS row_id, CAST(o.customer_id AS VARCHAR) AS key, m.ref_at
  FROM (SELECT DISTINCT id, customer_id FROM sales_orders WHERE customer_id IS NOT NULL) o
  JOIN (SELECT id, min(loaded_at) AS ref_at FROM sales_orders GROUP BY id) m ON m.id = o.id
  UNION SELECT 'mentions', 'entity_id', mention_id, {_key_sql("entity_id")}, seen_at FROM mentions WHERE entity_id IS NOT NULL
  UNION SELECT 'edges', 'source_id', edge_id, {_key_sql("source_id")}, seen_at FROM edges WHERE source_id IS NOT NULL
  UNION SELECT 'edges', 'target_id', edge_id, {_key_sql("target_id")}, seen_at FROM edges WHERE target_id IS NOT NULL
), parents AS (
  SELECT 'sales_orders' AS side, CAST(id AS VARCHAR) AS key, created_at, deleted_at FROM customers
  UNION ALL SELECT 'entities', {_key_sql("id")}, created_at, deleted_at FROM entities
), met AS (
  SELECT r.*, count(p.key) AS n, coalesce(bool_or((p.created_at IS NULL OR p.created_at <= r.ref_at) AND (p.deleted_at IS NULL OR p.deleted_at > r.ref_at)), false) AS there,
         bool_and(p.created_at > r.ref_at) AS late
  FROM refs r LEFT JOIN parents p ON p.key = r.key AND (p.side = 'sales_orders') = (r.ref_table = 'sales_orders')
  GROUP BY ALL
), orphans AS (
  SELECT ref_table, ref_field, row_id, key, ref_at, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS reason
  FROM met WHERE n = 0 OR NOT there
)
"""

_RUNS = """
r AS (SELECT *, coalesce(k <> lag(k) OVER (PARTITION BY key_range ORDER BY k) + 1, true) AS starts FROM k),
n AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY key_range ORDER BY k) AS run FROM r),
l AS (SELECT key_range, min(k) AS run_start, max(k) AS run_end, count(*) AS size FROM n GROUP BY key_range, run)
SELECT key_range, min(run_start) AS run_start, max(run_end) AS run_end, count(*) AS n_runs, CAST(sum(size) AS BIGINT) AS n_keys, max(size) AS longest FROM l GROUP BY key_range"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_customer_runs": p1_customer_runs, "p1_entity_runs": p1_entity_runs}
SQL = {
    "p1_found": _ORPHANS_SQL + "SELECT DISTINCT ref_table, ref_field, row_id, reason FROM orphans",
    "p1_report": _ORPHANS_SQL + "SELECT ref_table, ref_field, strftime(ref_at, '%Y-%m') AS period, reason, count(*) AS n_refs, count(DISTINCT key) AS n_keys FROM orphans GROUP BY ALL",
    "p1_customer_runs": "WITH k AS (SELECT DISTINCT id AS k, id >> 14 AS key_range FROM customers WHERE id IS NOT NULL)," + _RUNS,
    "p1_entity_runs": f"""
WITH ids AS (SELECT {_key_sql("id")} AS key, true AS parent FROM entities WHERE id IS NOT NULL
  UNION SELECT {_key_sql("entity_id")}, false FROM mentions WHERE entity_id IS NOT NULL
  UNION SELECT {_key_sql("source_id")}, false FROM edges WHERE source_id IS NOT NULL
  UNION SELECT {_key_sql("target_id")}, false FROM edges WHERE target_id IS NOT NULL),
one AS (SELECT key, bool_or(parent) AS parent FROM ids GROUP BY key),
d AS (SELECT *, row_number() OVER (ORDER BY key) AS number FROM one),
k AS (SELECT number AS k, number >> 14 AS key_range FROM d WHERE parent),""" + _RUNS,
}
