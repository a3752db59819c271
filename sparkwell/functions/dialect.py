"""Functions of a small SQL dialect that Spark spells otherwise, as columns and as SQL functions of a session.

Dates are texts (`YYYY-MM-DD`, with `HH:MM:SS`), numbers divide as whole numbers if both are whole, and an
empty sum is 0.0. Null in, null out, except for `total` and `type_name`.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_DAYS = "(unix_micros({t}) / 86400000000D + 2440587.5D)"
# What the letters of a time format stand for.
_FORMAT = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}
_FORMATTED = "f"
for _letter, _pattern in _FORMAT.items():
    _FORMATTED = f"replace({_FORMATTED}, '{_letter}', date_format(t, '{_pattern}'))"

#: Body of each SQL function; `t` is a timestamp, `x` a text, `f` a format, `p` a pattern of * ? and [...].
SQL_FUNCTIONS = {
    "date_text": ("t TIMESTAMP", "STRING", "date_format(t, 'yyyy-MM-dd')"),
    "time_text": ("t TIMESTAMP", "STRING", "date_format(t, 'HH:mm:ss')"),
    "datetime_text": ("t TIMESTAMP", "STRING", "date_format(t, 'yyyy-MM-dd HH:mm:ss')"),
    "julianday": ("t TIMESTAMP", "DOUBLE", _DAYS.format(t="t")),
    "unixepoch": ("t TIMESTAMP", "BIGINT", "unix_seconds(t)"),
    "strftime": ("f STRING, t TIMESTAMP", "STRING", _FORMATTED),
    "glob": ("p STRING, x STRING", "BOOLEAN", r"x RLIKE concat('(?s)^', replace(replace(regexp_replace(p, '([\\\\.+^$(){}|])', '\\\\$1'), '*', '.*'), '?', '.'), '$')"),
}


def register(spark: SparkSession) -> None:
    """Make SQL_FUNCTIONS known to the statements of the session."""
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")


def total(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def iif(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def type_name(x: Column) -> Column:
    kind = F.typeof(x)
    whole, real = ("tinyint", "smallint", "int", "bigint", "boolean"), ("float", "double")
    return F.when(x.isNull(), "null").when(kind.isin(*whole), "integer").when(kind.isin(*real) | kind.startswith("decimal"), "real").when(kind == "binary", "blob").otherwise("text")


def whole_divide(a: Column, b: Column) -> Column:
    """a / b of whole numbers, cut towards zero; null for b = 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))
