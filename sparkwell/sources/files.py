"""Readers and writers of the files that an index lives in.

Readers never fail on a missing file: it is an empty table. Writers write one folder
each; what a query reads again is written before it is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "id string, doc_id string, text string, title string, heading string, position int, source_path string"
GOLDEN = "question string, expected_substrings array<string>, category string, difficulty string, expected_tools array<string>"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with exactly the fields of the schema; blank lines are skipped, broken ones raise."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, CHUNKS)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, GOLDEN)


def read_catalogue(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The records under one field of a JSON file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.option("multiLine", True).schema(f"{field} array<struct<{','.join(_struct(schema))}>>").json(path)
    return whole.select(F.inline(field))


def _struct(schema: str) -> list[str]:
    return [re.sub(r"^(\w+)\s+", r"\1:", part.strip()) for part in re.split(r",(?![^<]*>)", schema)]


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunks as JSON lines; fields of the schema only."""
    chunks.select([c.split()[0] for c in CHUNKS.split(", ")]).write.mode(mode).json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def worked_examples(spark: SparkSession, path: str) -> DataFrame:
    """question, sql: the pairs of comment lines `-- Q:` and `-- SQL:` of the scripts."""
    text = spark.read.text(path, wholetext=True).select("value")
    pattern = r"(?m)^--\s*Q:\s*(.+?)\s*\n--\s*SQL:\s*(.+?)\s*$"
    both = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("question"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("sql"))
    return text.select(F.inline(both))


def clear(spark: SparkSession, path: str) -> bool:
    """Delete what was written at the path; False if nothing is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
