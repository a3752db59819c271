"""Key normalisation: names and `TYPE:name` keys."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The edge punctuation that a name loses on either side.
_LEFT = " \\s\"'(\\[,.;:"
_RIGHT = " \\s\"')\\],.;:"
_EDGES = re.compile(f"^[{_LEFT}]+|[{_RIGHT}]+$")
_SPACE = re.compile(r"\s+")


def normal_name(name: str) -> str:
    """NFKC, edge punctuation off, white space collapsed, case folded."""
    return _SPACE.sub(" ", _EDGES.sub("", unicodedata.normalize("NFKC", name))).strip().casefold()


def normal_key(key: str) -> str:
    kind, colon, rest = key.partition(":")
    return f"{kind}:{normal_name(rest)}" if colon else key


def _each_distinct(values: pd.Series, rule) -> pd.Series:
    done = {v: rule(v) for v in values.dropna().unique()}
    return values.map(done).astype(object).where(values.notna(), None)


@F.pandas_udf(T.StringType())
def normal_name_udf(values: pd.Series) -> pd.Series:
    return _each_distinct(values, normal_name)


@F.pandas_udf(T.StringType())
def normal_key_udf(values: pd.Series) -> pd.Series:
    return _each_distinct(values, normal_key)


def ascii_normal_name(name: Column) -> Column:
    """The same rule inside the JVM; exact where the name is ASCII."""
    cut = F.regexp_replace(F.regexp_replace(name, r"^[\s\"'(\[,.;:]+", ""), r"[\s\"')\],.;:]+$", "")
    return F.lower(F.trim(F.regexp_replace(cut, r"\s+", " ")))
