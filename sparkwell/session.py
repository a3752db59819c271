"""Session settings and table access shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "sparkwell", cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARKWELL_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a session on one machine may make its own."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="sparkwell-")


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Point checkpoint() at the shared folder of the cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))


#: Bytes that Spark adds to a file when it packs files into partitions; a scan has a partition for each at most.
OPEN_COST = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where the scan is too small for Spark to cut it into as many partitions.

    The size is the plan's own estimate of its sources: nothing is run to find it. Larger inputs stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return df.repartition(cores) if size < cores * OPEN_COST else df


#: Repeated rows whose places are sent to tasks; more are joined by shuffles.
MOST_PLACES = 1_000_000


def once(scan: DataFrame, *columns: str) -> DataFrame:
    """The rows of a Parquet scan, those that agree in `columns` once.

    Only hashes and places of rows are shuffled. The places of all but the first of equal rows are
    sent to tasks, up to MOST_PLACES of them; beyond that they are joined.
    """
    use_shared_checkpoints(scan.sparkSession)
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    rows = scan.select("*", F.xxhash64(file).alias("_file"), row.alias("_row"))
    # two hashes of the same columns: 128 bits, nulls told from empty texts by a count of nulls
    nulls = sum((F.col(c).isNull().cast("int") * (1 << k) for k, c in enumerate(columns)), F.lit(0))
    equal = [F.xxhash64(*columns), F.xxhash64(*reversed(columns), F.lit(7)), nulls]
    keyed = rows.select(*[e.alias(f"_e{k}") for k, e in enumerate(equal)], F.struct("_file", "_row").alias("place"))
    groups = keyed.groupBy("_e0", "_e1", "_e2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = keyed.join(groups, ["_e0", "_e1", "_e2"]).where("place <> first").select("place._file", "place._row").checkpoint()
    n = again.count()
    if n == 0:
        return scan
    return rows.join(F.broadcast(again) if n <= MOST_PLACES else again, ["_file", "_row"], "left_anti").drop("_file", "_row")
