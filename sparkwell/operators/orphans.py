"""References to records that do not exist, or not at the time of the reference.

Every distinct key, of parents and references, gets an integer: an integer key is
its own, and text keys are numbered in their order, by a sort over ranges and the
sizes of the ranges before. Parent integers are compressed into runs of consecutive
ones. Each distinct referenced key is matched as-of to the run that starts at or
before it: a key beyond that run's end has no parent.

Both the runs and the distinct references are cut into key ranges (the high bits
of the integer), so a range holds a bounded number of distinct keys however often
one of them is referenced. Only keys inside a run go on to the comparison of times:
lifetimes and references of a key stand in one order of time, and what began before
a reference and ends last tells whether the record was there. References of hot
keys are salted, with their lifetimes repeated for each salt.

Defined results: null keys are no references. Exact repeats of a reference count
once. A null time can't be compared, so such a reference is reported only when
its key is missing. A parent without a created_at exists from the beginning.
Empty parents make every reference missing; empty references give no rows. Only
the named columns are read; others may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import use_shared_checkpoints

#: Hot keys are those with more than 1/HOT_SHARE of all references: HOT_SHARE at most.
HOT_SHARE = 64
#: Salts of a hot key at least, and its references for each salt at most where that needs more.
SALTS, SALTED_ROWS = 16, 4_000_000
#: Distinct integers of a key range: two to this power.
RANGE_BITS = 14


def numbered(keys: DataFrame) -> DataFrame:
    """`keys` (with a distinct text `key`) plus `k`: dense integers in the order of the keys."""
    use_shared_checkpoints(keys.sparkSession)
    # where the ranges end is found by sampling: fixed before they are counted
    parts = keys.repartitionByRange(F.col("key")).withColumn("part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    return parts.withColumn("place", within).join(F.broadcast(starts), "part").withColumn("k", F.col("start") + F.col("place")).drop("part", "place", "start")


def runs_of(keys: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """(key_range, run_start, run_end) of the distinct integers in column `k`."""
    by = Window.partitionBy("key_range").orderBy("k")
    d = keys.select("k").where("k is not null").distinct().withColumn("key_range", F.shiftright("k", range_bits))
    d = d.withColumn("starts", F.coalesce(F.col("k") != F.lag("k").over(by) + 1, F.lit(True)))
    d = d.withColumn("run", F.sum(F.col("starts").cast("long")).over(by))
    return d.groupBy("key_range", "run").agg(F.min("k").alias("run_start"), F.max("k").alias("run_end")).drop("run")


def match_runs(keys: DataFrame, runs: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """`keys` (with a distinct integer `k`) plus `in_run`: as-of match to the preceding run start."""
    refs = keys.withColumn("key_range", F.shiftright("k", range_bits))
    at = refs.withColumns({"at": F.col("k"), "is_ref": F.lit(1), "run_end": F.lit(None).cast("long")})
    starts = runs.select("key_range", F.col("run_start").alias("at"), F.lit(0).alias("is_ref"), "run_end")
    by = Window.partitionBy("key_range").orderBy("at", "is_ref")
    both = at.unionByName(starts, allowMissingColumns=True)
    both = both.withColumn("end", F.last("run_end", ignorenulls=True).over(by)).where("is_ref = 1")
    return both.withColumn("in_run", F.coalesce(F.col("k") <= F.col("end"), F.lit(False))).drop("at", "is_ref", "run_end", "end", "key_range")


def key_numbers(refs: DataFrame, parents: DataFrame, normal: Callable[[Column], Column] | None) -> tuple[DataFrame, DataFrame]:
    """The spellings (raw, key, n_refs, is_parent) and the distinct keys (key, k, is_parent, is_ref) of both sides.

    `normal` turns a spelling into its key; each distinct spelling goes through it once. None: keys are integers.
    """
    use_shared_checkpoints(refs.sparkSession)
    asked = refs.groupBy(F.col("key").alias("raw")).agg(F.count("*").alias("n_refs"), F.lit(False).alias("is_parent"))
    known = parents.groupBy(F.col("key").alias("raw")).agg(F.lit(0).cast("long").alias("n_refs"), F.lit(True).alias("is_parent"))
    both = asked.unionByName(known).where("raw is not null").groupBy("raw").agg(F.sum("n_refs").alias("n_refs"), F.max("is_parent").alias("is_parent"))
    spelt = both.withColumn("key", normal(F.col("raw")) if normal else F.col("raw")).checkpoint()
    keys = spelt.groupBy("key").agg(F.max("is_parent").alias("is_parent"), (F.sum("n_refs") > 0).alias("is_ref"))
    return spelt, numbered(keys) if normal else keys.withColumn("k", F.col("key").cast("long"))


def orphan_references(refs: DataFrame, parents: DataFrame, normal: Callable[[Column], Column] | None = None, range_bits: int = RANGE_BITS) -> DataFrame:
    """References of `refs` whose record is absent.

    refs: ref_table, ref_field, row_id, key, at. parents: key, created_at,
    deleted_at. Keys are integers, or spellings that `normal` makes comparable.
    Returns the columns of refs, the key as compared, and `reason` (missing, late, deleted).
    """
    refs = refs.select("ref_table", "ref_field", "row_id", "key", "at").where("key is not null")
    parents = parents.select("key", "created_at", "deleted_at").where("key is not null")
    spelt, keys = key_numbers(refs, parents, normal)
    matched = match_runs(keys.where("is_ref").select("key", "k"), runs_of(keys.where("is_parent"), range_bits), range_bits)
    total = spelt.agg(F.sum("n_refs").alias("total"))
    # hot spellings are HOT_SHARE at most, by their definition
    salts = F.when(F.col("n_refs") > F.col("total") / HOT_SHARE, F.sequence(F.lit(0), F.greatest(F.lit(SALTS - 1), (F.col("n_refs") / SALTED_ROWS).cast("int")))).otherwise(F.array(F.lit(0)))
    asked = spelt.where("n_refs > 0").crossJoin(F.broadcast(total)).select("raw", "key", salts.alias("salts"))
    asked = asked.join(matched.select("key", "in_run"), "key").checkpoint()
    hot = asked.where("size(salts) > 1").select("raw", F.size("salts").alias("n_salts"))

    # lifetimes of a key stand under each of its spellings and salts
    lives = parents.select(F.col("key").alias("own"), "created_at", "deleted_at").distinct().join(spelt.where("is_parent").select(F.col("raw").alias("own"), "key"), "own")
    lives = lives.join(asked.where("in_run"), "key").select("raw", F.explode("salts").alias("salt"), F.lit(1).alias("kind"), F.col("created_at").alias("since"), "deleted_at")
    names = asked.select("raw", F.explode("salts").alias("salt"), F.lit(0).alias("kind"), "key", "in_run")
    asks = refs.withColumnRenamed("key", "raw").join(F.broadcast(hot), "raw", "left")
    asks = asks.select("raw", F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("n_salts")).cast("int"), F.lit(0)).alias("salt"), F.lit(2).alias("kind"), "ref_table", "ref_field", "row_id", "at")
    both = names.unionByName(lives, allowMissingColumns=True).unionByName(asks, allowMissingColumns=True)
    # names first, then lives and references in time; a life that begins with a reference is there
    order = Window.partitionBy("raw", "salt").orderBy((F.col("kind") > 0).cast("int"), F.coalesce("since", "at"), "kind")
    never = F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.withColumns({
        "known": F.max("in_run").over(so_far), "name": F.max("key").over(so_far), "begun": F.max(F.col("kind") == 1).over(so_far),
        "until": F.max(F.when(F.col("kind") == 1, F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), never))).over(so_far),
    })
    reason = F.when(~F.col("known"), "missing").when(F.col("at").isNull() | (F.col("until") > F.col("at").cast("timestamp_ntz")), None).when(F.col("begun"), "deleted").otherwise("late")
    found = told.where("kind = 2").select("ref_table", "ref_field", "row_id", F.col("name").alias("key"), "at", reason.alias("reason")).where("reason is not null")
    return found.distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, field, period (month of the reference) and reason."""
    period = F.date_format("at", "yyyy-MM")
    return found.groupBy("ref_table", "ref_field", period.alias("period"), "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("key").alias("n_keys"))
