"""The relational surface: read-only SQL over the tables, each statement checked first.

The statements are in the dialect that Spark and other engines share, so the SQL that
they are held against is the same text run elsewhere.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect
from ..operators.relational import run_sql
from ..session import table

STATEMENTS = {
    "scan_project": "SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS gross, upper(l_returnflag) AS flag FROM lineitem",
    "filter_predicates": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 150000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '%URGENT' AND NOT o_custkey IS NULL",
    "null_predicates": "SELECT id, country, industry FROM customers WHERE country IS NULL OR lower(industry) = 'retail'",
    "inner_join": "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey",
    "left_join": "SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'",
    "right_join": "SELECT m.mention_id, e.entity_no FROM mentions m RIGHT JOIN entities e ON e.id = m.entity_id",
    "full_join": "SELECT coalesce(c.id, o.customer_id) AS customer_id, c.n_rows, o.n_orders FROM (SELECT id, count(*) AS n_rows FROM customers GROUP BY id) c FULL OUTER JOIN (SELECT customer_id, count(*) AS n_orders FROM sales_orders GROUP BY customer_id) o ON o.customer_id = c.id",
    "theta_join": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey > r.r_regionkey",
    "three_way_join": "SELECT r.r_name, n.n_name, count(*) AS n_customers, round(sum(c.c_acctbal), 2) AS balance FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name, n.n_name",
    "self_join": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "semi_join": "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "anti_join": "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "in_subquery": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)",
    "not_in_null_aware": "SELECT id, name FROM customers WHERE id NOT IN (SELECT customer_id FROM sales_orders)",
    "not_in_without_nulls": "SELECT id, name FROM customers WHERE id NOT IN (SELECT customer_id FROM sales_orders WHERE customer_id IS NOT NULL)",
    "range_join": "SELECT c.id, o.id AS order_id FROM customers c JOIN sales_orders o ON o.customer_id = c.id AND o.loaded_at >= c.created_at AND (c.deleted_at IS NULL OR o.loaded_at < c.deleted_at)",
    "group_agg": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "global_agg": "SELECT count(*) AS n, round(sum(l_quantity * l_extendedprice), 0) AS gross, round(min(l_tax), 4) AS least_tax, round(max(l_tax), 4) AS most_tax FROM lineitem",
    "distinct_agg": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT o_orderpriority) AS n_priorities FROM orders GROUP BY o_orderstatus",
    "filter_agg": "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS open_qty FROM lineitem GROUP BY l_suppkey",
    "having": "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "listagg": "SELECT customer_id, string_agg(DISTINCT sku, ',') WITHIN GROUP (ORDER BY sku) AS skus FROM sales_orders WHERE customer_id IS NOT NULL GROUP BY customer_id",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT p_brand, p_size, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "window_frame_sum": "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM orders",
    "rank_windows": "SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) AS BIGINT) AS dr FROM supplier",
    "lag_lead": "SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events",
    "top_per_group": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 3",
    "limit_topk": "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25",
    "order_nulls": "SELECT id, name, industry, CAST(row_number() OVER (PARTITION BY country ORDER BY industry ASC NULLS FIRST, id, name, created_at, deleted_at NULLS LAST) AS BIGINT) AS place FROM (SELECT DISTINCT * FROM customers) c",
    "union_all": "SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier",
    "union_distinct": "SELECT lower(country) AS word FROM customers UNION SELECT lower(industry) FROM customers",
    "intersect": "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT id AS doc_key FROM chunks EXCEPT SELECT chunk_id FROM language_guesses",
    "scalar_subquery": "SELECT p_partkey, round(p_retailprice - (SELECT avg(p_retailprice) FROM part), 4) AS above_mean FROM part",
    "correlated_scalar": "SELECT o.o_orderkey, (SELECT max(l.l_extendedprice) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS dearest FROM orders o",
    "correlated_exists": "SELECT e.id, e.name FROM entities e WHERE EXISTS (SELECT 1 FROM edges g WHERE g.target_id = e.id AND g.type = 'MADE_BY')",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), mean AS (SELECT avg(total) AS m FROM big) SELECT o_custkey, round(total, 2) AS total FROM big JOIN mean ON total > m",
    "derived_table": "SELECT bucket, count(*) AS n FROM (SELECT CAST(floor(n_chars / 500) AS BIGINT) AS bucket FROM documents WHERE n_chars IS NOT NULL) d GROUP BY bucket",
    "case_cast": "SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_totalprice >= 50000 THEN 'middle' ELSE 'small' END AS size_class, CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR(20)) AS key_text FROM orders WHERE o_totalprice - floor(o_totalprice) < 0.49",
    "null_functions": "SELECT id, coalesce(sku, 'none') AS sku, nullif(status, 'open') AS closed_status, CASE WHEN customer_id IS NULL THEN 0 ELSE 1 END AS has_customer FROM sales_orders",
    "string_functions": "SELECT name, length(name) AS n, lower(name) AS low, upper(name) AS up, substr(name, 2, 5) AS part, replace(name, ' ', '_') AS joined, instr(name, 'a') AS first_a, trim(name) AS trimmed FROM entities",
    "concat_like": "SELECT id, type || '/' || name AS label FROM entities WHERE name ILIKE '%ro%' OR name LIKE 'B_f%'",
    "math_functions": "SELECT p_partkey, abs(p_size - 25) AS away, round(p_retailprice / 7, 3) AS seventh, CAST(ceil(p_retailprice) AS BIGINT) AS up, CAST(floor(p_retailprice) AS BIGINT) AS down, p_size % 7 AS rest, CAST(sign(p_size - 25) AS INT) AS side FROM part",
    "date_functions": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, date_trunc('month', o_orderdate) AS month_start FROM orders",
    "distinct_rows": "SELECT DISTINCT type, split_part(id, ':', 1) AS prefix FROM entities",
    "values_join": "SELECT v.label, count(*) AS n FROM events e JOIN (VALUES ('click', 'active'), ('view', 'passive'), ('error', 'broken')) AS v(event_type, label) ON v.event_type = e.event_type GROUP BY v.label",
    "revenue_by_year": "SELECT n.n_name, year(o.o_orderdate) AS y, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey GROUP BY n.n_name, year(o.o_orderdate)",
    "eval_categories": "SELECT coalesce(category, 'none') AS category, difficulty, count(*) AS n_items, count(DISTINCT passage) AS n_passages FROM golden_items GROUP BY coalesce(category, 'none'), difficulty",
    "dedup_latest": "SELECT id, customer_id, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, status, customer_id, sku) AS rn FROM sales_orders) o WHERE rn = 1",
    "json_extract": "SELECT event_id, get_json_object(props, '$.k') AS k FROM events",
    "dialect_dates": "SELECT event_id, date_text(ts) AS d, time_text(ts) AS t, datetime_text(ts) AS dt, round(julianday(ts), 3) AS jd, unixepoch(ts) AS epoch, strftime('%Y-%m %H:%M:%S / %d %j', ts) AS shown FROM events",
    "dialect_glob": "SELECT DISTINCT name FROM entities WHERE glob('*[aeiou]? *', name) OR glob('B*.?', name)",
}

# Where the other engine spells the same thing in another way.
ELSEWHERE = {
    "listagg": "SELECT customer_id, string_agg(DISTINCT sku, ',' ORDER BY sku) AS skus FROM sales_orders WHERE customer_id IS NOT NULL GROUP BY customer_id",
    "json_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "date_functions": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start FROM orders",
    "revenue_by_year": STATEMENTS["revenue_by_year"].replace("year(o.o_orderdate) AS y", "CAST(year(o.o_orderdate) AS INT) AS y"),
    "dialect_dates": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, round(epoch_us(ts) / 86400000000.0::DOUBLE + 2440587.5::DOUBLE, 3) AS jd, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS epoch, strftime(ts, '%Y-%m %H:%M:%S / %d %j') AS shown FROM events",
    "dialect_glob": "SELECT DISTINCT name FROM entities WHERE name GLOB '*[aeiou]? *' OR name GLOB 'B*.?'",
    "string_functions": STATEMENTS["string_functions"].replace("length(name) AS n", "CAST(length(name) AS INT) AS n").replace("instr(name, 'a')", "CAST(instr(name, 'a') AS INT)"),
}


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return run_sql(spark, sf_dir, sql)


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per type of event, about: a sketch whose standard error is 1 %, beside the share of the true number."""
    exact = F.countDistinct("user_id")
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("about"), exact.alias("n_users"))
    return rows.select("event_type", "n_users", (F.abs(F.col("about") / F.col("n_users") - 1) < 0.05).alias("is_near"))


def dialect_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, choices, types and whole division as the dialect has them."""
    rows = table(spark, sf_dir, "sales_orders")
    choice = dialect.iif(F.col("status") == "open", F.lit("waiting"), F.lit("done"))
    kinds = [dialect.type_name(F.col(c)).alias(f"{c}_type") for c in ("id", "sku", "unit_price_eur", "quantity")]
    whole = dialect.whole_divide(F.sum("quantity"), F.count("*"))
    out = rows.select("quantity", "unit_price_eur", choice.alias("state"), *kinds)
    return out.groupBy("state", "id_type", "sku_type", "unit_price_eur_type", "quantity_type").agg(dialect.total(F.col("quantity")).alias("total_quantity"), whole.cast("long").alias("mean_quantity"), dialect.total(F.lit(None).cast("int")).alias("nothing"))


QUERIES = {f"sql_{name}": partial(_run, sql=sql) for name, sql in STATEMENTS.items()} | {"sql_approx_distinct": approx_distinct, "sql_dialect_values": dialect_values}
SQL = {f"sql_{name}": ELSEWHERE.get(name, sql) for name, sql in STATEMENTS.items()} | {
    "sql_approx_distinct": "SELECT event_type, count(DISTINCT user_id) AS n_users, true AS is_near FROM events GROUP BY event_type",
    "sql_dialect_values": """
SELECT CASE WHEN status = 'open' THEN 'waiting' ELSE 'done' END AS state, CASE WHEN id IS NULL THEN 'null' ELSE 'integer' END AS id_type, CASE WHEN sku IS NULL THEN 'null' ELSE 'text' END AS sku_type,
  CASE WHEN unit_price_eur IS NULL THEN 'null' ELSE 'integer' END AS unit_price_eur_type, CASE WHEN quantity IS NULL THEN 'null' ELSE 'integer' END AS quantity_type,
  coalesce(sum(CAST(quantity AS DOUBLE)), 0.0::DOUBLE) AS total_quantity, CAST(sum(quantity) // count(*) AS BIGINT) AS mean_quantity, 0.0::DOUBLE AS nothing
FROM sales_orders GROUP BY ALL""",
}
