import re

from pyspark.sql import functions as F

from sparkwell.operators import extraction
from sparkwell.sources import files

SENTENCES = [
    "Atlas P2 is made by Auralis Dynamics, which is headquartered in Munich, Germany.",
    "Atlas P2 is certified to ISO 9001 and meets SOC 2 Type II; Atlas P2 carries CE marking.",
    "CEO Jane Miller spoke; Karl Heinz Vogt, CFO, did not. Nothing is located in Revenue.",
    "The hive of Brightwave Labs supplies Corvex Systems.",
    "",
    None,
    "no names at all",
]


def brute(sentence):
    spans = []
    for kind, pattern, group in extraction.RULES:
        for m in re.finditer(pattern, sentence):
            name = m.group(group)
            if kind == "LOCATION" and name.lower() in extraction.NOT_PLACES or len(name) < 2:
                continue
            if not any(a <= m.start(group) and m.end(group) <= b for a, b, _, _ in spans):
                spans.append((m.start(group), m.end(group), name, kind))
    return sorted(spans)


def test_mentions_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "sentence_id long, sentence string")
    rows = extraction.extract_mentions(df).collect()
    for k, sentence in enumerate(SENTENCES):
        got = sorted((r["start"], r["end"], r["name"], r["type"]) for r in rows if r["sentence_id"] == k)
        assert got == (brute(sentence) if sentence else [])
    assert {r["entity_id"] for r in rows} >= {"PRODUCT:atlas p2", "COMPANY:auralis dynamics", "LOCATION:munich", "STANDARD:soc 2 type ii", "PERSON:jane miller"}
    assert extraction.extract_mentions(df.limit(0)).collect() == []


def test_aliases_come_first(spark):
    df = spark.createDataFrame([(1, "The Atlas P2 hive and the HIVE")], "sentence_id long, sentence string")
    rows = extraction.extract_mentions(df, {"atlas p2 hive": ("Atlas Hive", "PRODUCT")}).collect()
    assert [(r["entity_id"], r["start"], r["end"]) for r in rows] == [("PRODUCT:atlas hive", 4, 17)]


def test_relations_and_cap(spark):
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "sentence_id long, sentence string")
    mentions = extraction.extract_mentions(df)
    found = {(r["source_id"], r["type"], r["target_id"]) for r in extraction.extract_relations(df, mentions).collect()}
    assert ("PRODUCT:atlas p2", "MADE_BY", "COMPANY:auralis dynamics") in found
    assert ("COMPANY:auralis dynamics", "LOCATED_IN", "LOCATION:munich") in found
    assert ("PRODUCT:atlas p2", "COMPLIES_WITH", "STANDARD:iso 9001") in found
    one = mentions.withColumn("chunk_id", F.lit("c")).withColumn("sentence_no", F.col("sentence_id"))
    kept = extraction.cap_entities(one, 2).select("entity_id").distinct().collect()
    assert {r[0] for r in kept} == {"PRODUCT:atlas p2", "COMPANY:auralis dynamics"}


def test_files(spark, tmp_path):
    where = str(tmp_path / "chunks")
    assert files.read_chunks(spark, where).count() == 0
    rows = spark.createDataFrame([("1:0", "1", "text", None, "h", 0, "p")], files.CHUNKS)
    files.write_chunks(rows, where)
    files.write_chunks(rows, where)
    assert files.read_chunks(spark, where).collect() == rows.collect() * 2
    script = tmp_path / "s.sql"
    script.write_text("create table t(x int);\n-- Q: How many?\n-- SQL: select count(*) from t\n")
    assert [tuple(r) for r in files.worked_examples(spark, str(script)).collect()] == [("How many?", "select count(*) from t")]
    (tmp_path / "c.json").write_text('{"products": [{"sku": "A", "price": 3}]}')
    assert [tuple(r) for r in files.read_catalogue(spark, str(tmp_path / "c.json"), "products", "sku string, price int").collect()] == [("A", 3)]
    assert files.clear(spark, where) and not files.clear(spark, where)
