"""Registered queries of the training-data operators: QUERIES and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import once, table
from .langid import Detector, detect_languages, fit, language_stretches, latest_guess, mislabelled
from .leaks import find_leaks
from .mixing import actual_shares, mix_sources, token_counter
from .names import link_names, name_pairs
from .readability import reading_bands
from .sentences import split_sentences
from .splitting import split_items

#: A vocabulary file of a public tokenizer; the counts of p7 are in its tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _units(spark: SparkSession, sf_dir: str, *which: tuple[str, str, str], distinct: bool = False) -> DataFrame:
    """unit_table, unit_id, text of the named (table, id column, text column)s; distinct: equal rows once."""
    scan = lambda t, i, x: once(table(spark, sf_dir, t), i, x) if distinct else table(spark, sf_dir, t)
    parts = [scan(t, i, x).select(F.lit(t).alias("unit_table"), F.col(i).cast("string").alias("unit_id"), F.col(x).alias("text")) for t, i, x in which]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- p2: variant names
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(table(spark, sf_dir, "customers"), table(spark, sf_dir, "entities"), table(spark, sf_dir, "mentions"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name of customers, companies, persons and unlinked mentions with the class that it belongs to."""
    customers = table(spark, sf_dir, "customers").select(F.lit("customer").alias("space"), "name")
    entities = table(spark, sf_dir, "entities").where(F.col("type").isin("COMPANY", "PERSON")).select(F.lit("entity").alias("space"), "name")
    mentions = table(spark, sf_dir, "mentions").where("entity_id is null").select(F.lit("entity").alias("space"), F.col("surface").alias("name"))
    return link_names(customers.unionByName(entities).unionByName(mentions))


# ---- p3: languages
_detectors: dict[tuple[str, str], Detector] = {}


def _detector(spark: SparkSession, sf_dir: str) -> Detector:
    """Trained once for the tables of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _detectors:
        _detectors[key] = fit(table(spark, sf_dir, "documents"))
    return _detectors[key]


def _p3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit("documents").alias("unit_table"), F.col("doc_id").cast("string").alias("unit_id"), F.col("lang").alias("label"), "text", F.lit(False).alias("is_piece"))


def _p3_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of documents and chunks; the chunks' guesses join their languages, not their texts."""
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("unit_table"), F.col("id").alias("unit_id"), F.lit(None).cast("string").alias("label"), "text", F.lit(True).alias("is_piece"))
    told = detect_languages(_p3_documents(spark, sf_dir).unionByName(chunks), _detector(spark, sf_dir)).distinct()
    guess = latest_guess(table(spark, sf_dir, "language_guesses")).select(F.lit("chunks").alias("unit_table"), F.col("chunk_id").alias("unit_id"), F.col("label").alias("guess"))
    return told.join(guess, ["unit_table", "unit_id"], "left").withColumn("label", F.coalesce("guess", "label")).drop("guess")


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language of every document and chunk, with its confidence."""
    return _p3_told(spark, sf_dir).drop("label").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled(_p3_told(spark, sf_dir)).select("unit_table", "unit_id", "language").distinct()


def p3_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-language stretches of the documents."""
    return language_stretches(_p3_documents(spark, sf_dir), _detector(spark, sf_dir))


# ---- p4: sentences
_P4 = (("chunks", "id", "text"), ("edges", "edge_id", "sentence"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(_units(spark, sf_dir, *_P4), with_text=False).select("unit_table", "unit_id", "end_char").distinct()


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences themselves, of every distinct text."""
    return split_sentences(_units(spark, sf_dir, *_P4, distinct=True))


# ---- p5: oversized items
def _p5_items(spark: SparkSession, sf_dir: str, distinct: bool = False) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.lit("documents").alias("item_table"), F.col("doc_id").cast("string").alias("item_id"), F.lit(None).cast("string").alias("heading"), "text")
    # documents are unique, chunks repeat
    chunks = once(table(spark, sf_dir, "chunks"), "id", "heading", "text") if distinct else table(spark, sf_dir, "chunks")
    return documents.unionByName(chunks.select(F.lit("chunks").alias("item_table"), F.col("id").alias("item_id"), "heading", "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(_p5_items(spark, sf_dir), with_text=False).where("position = 1").select("item_table", "item_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the oversized items, with heading, position and text."""
    return split_items(_p5_items(spark, sf_dir, distinct=True).where(F.length("text") > 900))


# ---- p6: leaks of evaluation items
def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak, with what of the item the document holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "golden_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("item_id", "doc_id").distinct()


# ---- p7: mixing
def _p7(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return mix_sources(table(spark, sf_dir, "documents"), targets, token_counter(TOKENIZER)), targets


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actual_shares(*_p7(spark, sf_dir))


# ---- p8: reading level
def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of each document with the measures behind it."""
    return reading_bands(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).select("doc_id", "band").distinct()


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_languages": p3_languages, "p3_stretches": p3_stretches, "p4_found": p4_found, "p4_sentences": p4_sentences, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_levels": p8_levels}
SQL: dict[str, str] = {
    "p5_found": """
SELECT DISTINCT 'documents' AS item_table, CAST(doc_id AS VARCHAR) AS item_id FROM documents WHERE length(text) > 900
UNION SELECT DISTINCT 'chunks', id FROM chunks WHERE length(text) > 900""",
}
