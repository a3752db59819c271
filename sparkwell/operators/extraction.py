"""Entity mentions and relations read from sentences by rules, inside the JVM.

Each rule is a pattern with a type and a precedence. A pattern's matches come from
regexp_extract_all; each is looked up behind the end of the one before it, which
gives its place. All rules' matches of a sentence stand in one array in order of
precedence; a match that lies inside one of higher precedence is dropped.

Defined results: null and empty sentences have no mentions. Names of one letter
are none. Repeated sentences give repeated mentions. Names by which an alias table
(surface, name, type) knows an entity come first, longest first, at their first place in the
sentence; their ids come from the alias table's name and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import normal_name_udf
from . import graph

#: Aliases are configuration: they become literals of the plan, so their number is bounded.
MAX_ALIASES = 1_000
ENTITY_CAP = 12

# What names a standard, a company, a person's office, a place.
STANDARD_FAMILIES = ["ISO", "IEC", "EN", "DIN", "ANSI", "IEEE", "SOC"]
STANDARDS_BY_NAME = ["GDPR", "CE marking", "SOC 2 Type II", "SOC 2 Type I"]
COMPANY_SUFFIXES = ["Dynamics", "Ventures", "Technologies", "Robotics", "Systems", "Solutions", "Industries", "Group", "Labs", "Holdings", "GmbH", "AG", "SE", "Inc", "Ltd", "Corp", "LLC", "NV", "BV"]
OFFICES = ["CEO", "CTO", "CFO", "COO"]
TITLES = ["Dr", "Mr", "Ms", "Mrs", "Prof"]
PLACE_CUES = ["based in", "headquartered in", "located in", "founded in", "offices in", "headquarters in", "plant in", "site in"]
# Capitalised words after a place cue that are no places.
NOT_PLACES = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "the", "every", "each", "this", "that", "these", "those",
    "operation", "mixed", "robot", "european", "eu", "north", "south", "east", "west", "q1", "q2", "q3", "q4",
    "revenue", "revenues", "growth", "margin", "earnings", "sales", "orders", "segment", "segments", "therapies", "imaging", "diagnostics", "cloud",
    "software", "services", "total", "group", "line", "lines", "business", "market", "markets", "region", "regions", "quarter", "half", "year",
    "guidance", "outlook", "portfolio", "demand", "pricing", "costs",
]

_WORD = r"[A-Z][\w&.-]*"
_FULL_NAME = r"(?:[A-Z][a-z]+\s+){1,2}[A-Z][a-z]+"


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


# Fixed values: (type, pattern, group of the name), in order of precedence.
RULES = [
    ("STANDARD", rf"\b({_any(STANDARDS_BY_NAME)})\b", 1),
    ("PRODUCT", r"\b([A-Z][a-zA-Z]+\s+[A-Z]{1,3}\d+[A-Za-z]*)\b", 1),
    ("COMPANY", rf"\b((?:{_WORD}\s+){{0,3}}?{_WORD}\s+{_any(COMPANY_SUFFIXES)})\b", 1),
    ("STANDARD", rf"\b({_any(STANDARD_FAMILIES)}[\s/-]?\d[\w\-:./]*)", 1),
    ("PERSON", rf"\b{_any(OFFICES + TITLES)}\.?\s+({_FULL_NAME})\b", 1),
    ("PERSON", rf"\b({_FULL_NAME}),\s+{_any(OFFICES)}\b", 1),
    ("LOCATION", rf"\b{_any(PLACE_CUES)}\s+(?:\d{{4}}\s+in\s+)?([A-Z][a-z]{{2,}})(?:,\s+[A-Z][a-z]{{2,}})?\b", 1),
]
_NONE = "array<struct<start:int,end:int,surface:string,name:string,type:string>>"


def _span(start: Column, surface: Column, name: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), (start + F.length(surface)).cast("int").alias("end"), surface.alias("surface"), name.alias("name"), F.lit(kind).alias("type"))


def _matches(sentence: Column, kind: str, pattern: str, group: int) -> Column:
    """Spans of a rule: whole matches and their names, each looked up behind the match before."""
    both = F.arrays_zip(F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(sentence, F.lit(pattern), F.lit(group)).alias("own"))
    begin = F.struct(F.lit(1).alias("at"), F.array().cast(_NONE).alias("out"))

    def step(s: Column, m: Column) -> Column:
        at = F.call_function("locate", m["whole"], sentence, s["at"])
        start = at - 1 + F.call_function("locate", m["own"], m["whole"]) - 1
        return F.struct((at + F.length(m["whole"])).alias("at"), F.concat(s["out"], F.array(_span(start, m["own"], m["own"], kind))).alias("out"))

    found = F.aggregate(both, begin, step)["out"]
    if kind == "LOCATION":
        found = F.filter(found, lambda m: ~F.lower(m["name"]).isin(NOT_PLACES))
    return F.filter(found, lambda m: F.length(F.trim(m["name"])) >= 2)


def _alias_matches(sentence: Column, aliases: dict[str, tuple[str, str]]) -> list[Column]:
    out = []
    for surface in sorted(aliases, key=lambda s: (-len(s), s)):
        name, kind = aliases[surface]
        at = F.locate(surface.lower(), F.lower(sentence))
        span = F.array(_span(at - 1, F.substring(sentence, at, F.lit(len(surface))), F.lit(name), kind))
        out.append(F.when(at > 0, span).otherwise(F.array().cast(_NONE)))
    return out


def mentions_of(sentence: Column, aliases: dict[str, tuple[str, str]] | None = None) -> Column:
    """Array of start, end, surface, name, type: the mentions of a sentence in order of their start."""
    aliases = {s: v for s, v in (aliases or {}).items() if s}
    if len(aliases) > MAX_ALIASES:
        raise ValueError(f"at most {MAX_ALIASES} aliases")
    found = F.concat(*_alias_matches(sentence, aliases), *[_matches(sentence, *rule) for rule in RULES])
    numbered = F.transform(found, lambda m, n: F.struct(m["start"].alias("start"), n.alias("n"), m.alias("m")))
    # what lies inside a dropped span lies inside the one that dropped it, so one look at all of higher precedence is enough
    inside = lambda x, all_: F.exists(all_, lambda y: (y["n"] < x["n"]) & (y["start"] <= x["start"]) & (y["m"]["end"] >= x["m"]["end"]))
    kept = F.transform(F.array(numbered), lambda all_: F.filter(all_, lambda x: ~inside(x, all_)))[0]
    return F.transform(F.array_sort(kept), lambda x: x["m"])


def extract_mentions(sentences: DataFrame, aliases: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """sentence_id, entity_id, name, type, start, end of every mention; sentences: sentence_id, sentence."""
    found = sentences.where("sentence is not null").select("sentence_id", F.explode(mentions_of(F.col("sentence"), aliases)).alias("m"))
    name = F.trim("m.name")
    return found.select("sentence_id", F.concat("m.type", F.lit(":"), normal_name_udf(name)).alias("entity_id"), name.alias("name"), F.col("m.type").alias("type"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))


def cap_entities(mentions: DataFrame, cap: int = ENTITY_CAP) -> DataFrame:
    """The mentions of a chunk's first `cap` entities, by first appearance.

    mentions: chunk_id, sentence_no, entity_id, start and more.
    """
    first = mentions.groupBy("chunk_id", "entity_id").agg(F.min(F.struct("sentence_no", "start", "entity_id")).alias("seen"))
    order = Window.partitionBy("chunk_id").orderBy("seen")
    kept = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("chunk_id", "entity_id")
    return mentions.join(kept, ["chunk_id", "entity_id"], "left_semi")


def extract_relations(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """sentence_id, source_id, target_id, type between the mentions of a sentence."""
    return graph.relations(mentions.select("sentence_id", "entity_id", "type", "start", "end"), sentences)
