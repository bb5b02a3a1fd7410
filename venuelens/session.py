"""Session defaults for local runs and a place for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "venuelens", memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    shuffle = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def task_count(spark: SparkSession) -> int:
    """Tasks for rows that each carry much work, where small data must not mean few tasks."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else unchanged.

    At most ``max_rows + 1`` rows are counted.  Without the hint a table that was built in
    Python counts as unboundedly large, and the other side would be shuffled.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle once if the source gives fewer tasks than there are cores.

    One file with one row group is read by one task; cutting its texts there would leave
    the other cores idle.  A source with enough tasks is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables, one that every executor reaches.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset, a folder of the
    warehouse is used, unless that is one machine's own.  Never a machine-local temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return f"{warehouse.rstrip('/')}/_written"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a parquet table and continue from the files.

    Cuts the lineage: losing an executor later costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
