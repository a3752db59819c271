"""The entity graph: two tables, upserts by document, neighbours, walks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import spread, use_shared_checkpoints

# Which types an edge may join.
DOMAINS = [("MADE_BY", "PRODUCT", "COMPANY"), ("SUPPLIES", "COMPANY", "COMPANY"), ("SUPPLIES", "COMPANY", "PRODUCT"), ("COMPLIES_WITH", "PRODUCT", "STANDARD"), ("COMPLIES_WITH", "COMPANY", "STANDARD"), ("LOCATED_IN", "COMPANY", "LOCATION"), ("LOCATED_IN", "PERSON", "LOCATION")]
# Words between two mentions that name their relation, in order of precedence.
CUES = {
    "MADE_BY": ["from", "by", "made by", "built by", "manufactured by", "developed by", "von"],
    "COMPLIES_WITH": ["certified to", "certified", "complies with", "conforms to", "meets", "carries", "accredited to", "zertifiziert", "nach", "معتمدة", "通过"],
    "LOCATED_IN": ["in", "based in", "headquartered in", "founded in", "located in", "operates in"],
    "SUPPLIES": ["supplies", "supplier of", "provides", "sells", "delivers", "integrates with"],
}
ORDER = {"MADE_BY": 1, "COMPLIES_WITH": 2, "LOCATED_IN": 3, "SUPPLIES": 4}
MAX_GAP, MAX_HOPS, MAX_CHUNKS, MAX_NODES, MAX_SEEDS = 90, 4, 6, 40, 8


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAINS, "type string, source_type string, target_type string")


def in_domain(edges: DataFrame) -> DataFrame:
    """Edges whose ends have types that the edge type allows."""
    typed = edges.withColumn("source_type", F.split_part("source_id", F.lit(":"), F.lit(1))).withColumn("target_type", F.split_part("target_id", F.lit(":"), F.lit(1)))
    return typed.join(F.broadcast(domains(edges.sparkSession)), ["type", "source_type", "target_type"], "left_semi").select(edges.columns)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per source, target, type and chunk: the last one extracted."""
    last = Window.partitionBy("source_id", "target_id", "type", "chunk_id").orderBy(F.desc("seen_at"), F.desc("edge_id"))
    return edges.where("source_id is not null and target_id is not null").withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def replace_documents(table: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table with all rows of the incoming documents replaced."""
    return table.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def used_entities(entities: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that a mention or an edge still refers to."""
    used = mentions.select(F.col("entity_id").alias("id")).unionByName(edges.select(F.col("source_id").alias("id"))).unionByName(edges.select(F.col("target_id").alias("id")))
    return entities.join(used.distinct(), "id", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """node, neighbour, type, is_source: every edge from either end."""
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), "type", F.lit(True).alias("is_source"))
    return out.unionByName(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), "type", F.lit(False).alias("is_source")))


#: Questions whose marks share a row of a walk, a bit each, in words of 64 bits.
WORDS = 8
BLOCK = 64 * WORDS
#: Questions whose keys are sent to tasks; those of more are joined.
MOST_ASKED = 1_000_000


def _numbered(seeds: DataFrame) -> tuple[DataFrame, int]:
    """qid, node, block, place: every question has a place of its own in a block of BLOCK at most; the number of questions.

    Places are counted from 0 within a block, without gaps. A null question is one too.
    """
    n = seeds.select("qid").distinct().count()
    blocks = max(1, -(-10 * n // (9 * BLOCK)))
    seeds = seeds.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    rank = F.dense_rank().over(Window.partitionBy("block").orderBy("qid")) - 1
    seeds = seeds.withColumn("rank", rank)
    # the few that a bucket has beyond BLOCK go to a block of their own
    block = F.col("block") + blocks * F.floor(F.col("rank") / BLOCK)
    return seeds.select("qid", "node", block.alias("block"), (F.col("rank") % BLOCK).alias("place")), n


def _joined_marks(a: Column, b: Column) -> Column:
    """Maps of block to words, those of a block in both put together bit by bit."""
    either = lambda x, y, both: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(both)
    words = lambda x, y: F.zip_with(x, y, lambda v, w: v.bitwiseOR(w))
    return either(a, b, F.map_zip_with(a, b, lambda _, x, y: either(x, y, words(x, y))))


def _places(batches: Iterator[pa.RecordBatch], levels: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From the bits of an edge's block, a row for each hop with the places of the questions that walk the edge at it first."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            words = part.column("bits").flatten().to_numpy(zero_copy_only=False)
            within = np.unpackbits(words.view(np.uint8).reshape(part.num_rows, levels, BLOCK // 8), axis=2, bitorder="little")
            # a mark stays from level to level: the first counts
            first = np.diff(within, axis=1, prepend=np.uint8(0))
            counts = first.sum(axis=2, dtype=np.int64).ravel()
            some = np.flatnonzero(counts)
            ends = np.concatenate([[0], np.cumsum(counts[some])])
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(first)[2], pa.int32()))
            kept = part.select(["source_id", "target_id", "type", "block"]).take(pa.array(some // levels))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(some % levels + 1, pa.int32()), places], schema=schema)


def walk(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """qid, source_id, target_id, type, hop: edges within reach of the seeds (qid, node), at their least hop.

    Level by level for all questions at once; at most four levels. Most questions that come near a
    node of many edges walk the same edges, so rows of questions and edges grow with the square of the
    input. They are made last, from an edge's own row, and never shuffled: until then a node has a bit
    for each question of a block and level. An edge's least hop is one more than the nearer end's distance.
    """
    levels = max(1, min(hops, MAX_HOPS))
    asked, n = _numbered(seeds.select("qid", "node").where("node is not null").distinct())
    e = edges.select("source_id", "target_id", "type").where("source_id is not null and target_id is not null").distinct()
    ends = both_ways(e).select("node", "neighbour").distinct()
    # a node keeps its own marks
    ends = ends.withColumn("own", F.lit(False)).unionByName(ends.select("node", F.col("node").alias("neighbour"), F.lit(True).alias("own")).distinct())
    names = [[f"w{level}_{k}" for k in range(WORDS)] for level in range(levels)]
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    near = asked.groupBy("node", "block").agg(*[F.bit_or(F.when(F.floor(F.col("place") / 64) == k, bit).otherwise(0)).alias(c) for k, c in enumerate(names[0])])
    for level in range(1, levels):
        met = near.join(ends, "node")
        kept = [F.bit_or(F.when(F.col("own"), F.col(c)).otherwise(0)).alias(c) for words in names[:level] for c in words]
        near = met.groupBy(F.col("neighbour").alias("node"), "block").agg(*kept, *[F.bit_or(c).alias(new) for c, new in zip(names[level - 1], names[level])])
    marks = near.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("block", F.array(*[c for words in names for c in words])))).alias("marks"))
    side = lambda c: marks.select(F.col("node").alias(c + "_id"), F.col("marks").alias(c))
    both = e.join(side("source"), "source_id", "left").join(side("target"), "target_id", "left")
    each = both.select("source_id", "target_id", "type", F.explode(_joined_marks(F.col("source"), F.col("target"))).alias("block", "bits"))
    schema = T.StructType([*each.select("source_id", "target_id", "type", "block").schema, T.StructField("hop", T.IntegerType(), False), T.StructField("places", T.ArrayType(T.IntegerType(), False), False)])
    arrow = to_arrow_schema(schema)
    each = each.mapInArrow(lambda batches: _places(batches, levels, arrow), schema)
    keys = asked.groupBy("block").agg(F.sort_array(F.collect_set(F.struct("place", "qid"))).alias("at")).select("block", F.col("at.qid").alias("qids"))
    each = each.join(F.broadcast(keys) if n <= MOST_ASKED else keys, "block").select("qids", "source_id", "target_id", "type", "hop", F.explode("places").alias("place"))
    return each.select(F.get("qids", "place").alias("qid"), "source_id", "target_id", "type", "hop")


def best_seeds(links: DataFrame, entities: DataFrame, most: int = MAX_SEEDS) -> DataFrame:
    """qid, node, place: the entities that a question names (qid, id), longest name first, `most` at most.

    entities: id, name. Of several names of an entity the longest counts; ties go by id.
    """
    names = entities.groupBy(F.col("id").alias("node")).agg(F.max(F.length("name")).alias("size"))
    met = links.select("qid", F.col("id").alias("node")).distinct().join(names, "node")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("size"), "node"))
    return met.withColumn("place", place).where(F.col("place") <= most).select("qid", "node", "place")


def breadth_first(edges: DataFrame, seeds: DataFrame, hops: int = 2, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """What a walk outward from the seeds (qid, node, place) meets, for all questions at once.

    Nodes are expanded in the order in which they are found until `max_nodes` are seen; the node that passes
    the number is expanded to its end. Steps: qid, source_id, target_id, type, chunk_id, hop (an edge once, at its
    least hop). Reached: qid, node, place, hop. edges: edge_id, source_id, target_id, type, chunk_id.
    """
    use_shared_checkpoints(edges.sparkSession)
    e = edges.select("edge_id", "source_id", "target_id", "type", "chunk_id").where("source_id is not null and target_id is not null")
    steps = e.withColumn("node", F.col("source_id")).withColumn("neighbour", F.col("target_id")).unionByName(e.withColumn("node", F.col("target_id")).withColumn("neighbour", F.col("source_id")))
    front = seeds.select("qid", "node", F.col("place").cast("int").alias("place")).distinct().checkpoint()
    seen = front.select("qid", "node", "place", F.lit(0).alias("hop"))
    walked = None
    for hop in range(1, max(1, min(hops, MAX_HOPS)) + 1):
        met = front.join(steps, "node")
        new = met.join(seen.select("qid", F.col("node").alias("neighbour")), ["qid", "neighbour"], "left_anti")
        # a node belongs to the first that finds it
        new = new.groupBy("qid", "neighbour").agg(F.min(F.struct("place", "edge_id")).alias("by")).select("qid", "neighbour", "by.place", "by.edge_id")
        found = new.groupBy("qid", "place").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        had = seen.groupBy("qid").agg(F.count("*").alias("had"))
        expanded = front.join(found, ["qid", "place"], "left").withColumn("before", before).join(had, "qid").where(F.col("before") + F.col("had") < max_nodes).select("qid", "place").checkpoint()
        here = met.join(expanded, ["qid", "place"], "left_semi").select("qid", "source_id", "target_id", "type", "chunk_id", F.lit(hop).alias("hop"))
        walked = here if walked is None else walked.unionByName(here)
        order = Window.partitionBy("qid").orderBy("place", "edge_id", "neighbour")
        front = new.join(expanded, ["qid", "place"], "left_semi").select("qid", F.col("neighbour").alias("node"), F.row_number().over(order).alias("place")).checkpoint()
        seen = seen.unionByName(front.withColumn("hop", F.lit(hop)))
    steps = walked.groupBy("qid", "source_id", "target_id", "type").agg(F.min("hop").alias("hop"), F.min(F.struct("hop", "chunk_id")).alias("at"))
    return steps.select("qid", "source_id", "target_id", "type", F.col("at.chunk_id").alias("chunk_id"), "hop"), seen


def walked_chunks(steps: DataFrame, reached: DataFrame, mentions: DataFrame, most: int | None = MAX_CHUNKS) -> DataFrame:
    """qid, chunk_id, place: chunks of the walked edges by hop, then chunks that mention what was reached."""
    own = steps.select("qid", "chunk_id", F.lit(0).alias("kind"), "hop", F.col("source_id").alias("name"))
    said = reached.join(mentions.select(F.col("entity_id").alias("node"), "chunk_id"), "node").select("qid", "chunk_id", F.lit(1).alias("kind"), F.lit(0).alias("hop"), F.lit("").alias("name"))
    first = own.unionByName(said).where("chunk_id is not null").groupBy("qid", "chunk_id").agg(F.min(F.struct("kind", "hop", "name", "chunk_id")).alias("at"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    out = first.select("qid", "chunk_id", place.alias("place"))
    return out if most is None else out.where(F.col("place") <= most)


def path_lines(steps: DataFrame) -> DataFrame:
    return steps.select("qid", F.format_string("hop %d: %s -[%s]-> %s", "hop", "source_id", "type", "target_id").alias("line"))


def relations(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """sentence_id, source_id, target_id, type: pairs of mentions with a cue between them.

    mentions: sentence_id, entity_id, type, start, end (code points). sentences: sentence_id, sentence.
    """
    spark = mentions.sparkSession
    a = mentions.select("sentence_id", F.col("entity_id").alias("source_id"), F.col("type").alias("source_type"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = mentions.select("sentence_id", F.col("entity_id").alias("target_id"), F.col("type").alias("target_type"), F.col("start").alias("b_start"))
    pairs = a.join(b, "sentence_id").where((F.col("source_id") != F.col("target_id")) & (F.col("a_start") < F.col("b_start")) & (F.col("b_start") - F.col("a_end") <= MAX_GAP) & (F.col("b_start") >= F.col("a_end")))
    pairs = pairs.join(sentences.select("sentence_id", "sentence"), "sentence_id").withColumn("gap", F.lower(F.substring(F.col("sentence"), F.col("a_end") + 1, F.col("b_start") - F.col("a_end"))))
    cues = spark.createDataFrame([(t, ORDER[t], c) for t, c in CUES.items()], "type string, n int, cues array<string>")
    allowed = F.broadcast(domains(spark).join(cues, "type"))
    met = pairs.join(allowed, ["source_type", "target_type"]).where(F.exists("cues", lambda c: F.contains(F.col("gap"), c)))
    return met.groupBy("sentence_id", "source_id", "target_id").agg(F.min_by("type", "n").alias("type"))


#: Length of the piece of a name by which it is looked up in texts.
GRAM = 4


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda n: n.strip().casefold(), na_action="ignore")


def _keyed(names: list[str]) -> tuple[dict[str, list[int]], list[int]]:
    """Numbers of the names by the least frequent of their pieces; numbers of those shorter than a piece."""
    pieces = [{n[k : k + GRAM] for k in range(len(n) - GRAM + 1)} for n in names]
    count = Counter(g for own in pieces for g in own)
    keyed: dict[str, list[int]] = {}
    for k, own in enumerate(pieces):
        if own:
            keyed.setdefault(min(own, key=lambda g: (count[g], g)), []).append(k)
    return keyed, [k for k, own in enumerate(pieces) if not own]


def link_names(texts: DataFrame, key: str, text: str, names: DataFrame, shard_names: int = 200_000) -> DataFrame:
    """key, id of the entities one of whose names (id, name) stands in the text, whatever its case and what it touches.

    `shard_names` names are sent to tasks at most; more go in several passes over the texts. Names are
    trimmed. Null and blank names, null texts link to nothing. Repeated texts and names give one row.
    """
    spark = texts.sparkSession
    names = names.where("name is not null").select("id", _folded("name").alias("name")).where("name <> ''").distinct().persist()
    shards = max(1, -(-names.select("name").distinct().count() // shard_names))
    texts = spread(texts.select(key, text).where(F.col(text).isNotNull()))
    out = None
    for shard in range(shards):
        part = names.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == shard)
        each = [r["name"] for r in part.select("name").distinct().toLocalIterator()]
        shared = spark.sparkContext.broadcast((each, *_keyed(each)))

        def run(batches, shared=shared):
            each, keyed, short = shared.value
            for pdf in batches:
                rows = []
                for k, x in zip(pdf[key], pdf[text]):
                    x = x.casefold()
                    near = keyed.keys() & {x[i : i + GRAM] for i in range(len(x) - GRAM + 1)}
                    rows += [(k, each[n]) for g in near for n in keyed[g] if each[n] in x]
                    rows += [(k, each[n]) for n in short if each[n] in x]
                yield pd.DataFrame(rows, columns=[key, "name"])

        found = texts.mapInPandas(run, T.StructType([texts.schema[key], T.StructField("name", T.StringType())]))
        found = found.join(part, "name").select(key, "id")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
