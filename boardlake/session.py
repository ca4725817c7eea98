"""Spark session helpers.

Library code never creates a session of its own; these helpers are for tests, the
bench and command-line use.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the
session (the shared folder a cluster names) and only sets a scratch folder when the
session has none, as in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "boardlake") -> SparkSession:
    """A local session with the settings the tests and bench use (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BOARDLAKE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Only a local session without one gets a scratch folder; on a cluster a machine-local
    folder would lose files with its machine, so there the setting is required.
    """
    context = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(conf_dir)
        return conf_dir
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="boardlake-ckpt-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a source that one task takes, before the operators multiply or group them.
ROWS_A_TASK = 1 << 19


def spread(df: DataFrame, rows: int = 0, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Round-robin a source that arrives in fewer partitions than the cluster has cores, or than its ``rows`` need.

    A large table already comes in thousands of splits and is left alone; a table stored
    as one small file (one scan task) would otherwise run every row-local step on a single
    core.  Round-robin (not by key) so a hot key cannot make one partition large.  With ``rows`` (their number
    in all) a task gets ``rows_a_task`` of them at most, so that what a task holds does not grow with the table.
    """
    if os.environ.get("BOARDLAKE_SPREAD", "1") == "0":
        return df
    target = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_a_task))
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def by_key(df: DataFrame, *keys) -> DataFrame:
    """Hash-partition by key into the session's number of shuffle partitions.

    Adaptive execution merges the partitions of a plain shuffle up to a size in compressed bytes, and a sorted window over small
    integers holds many times that; a shuffle with a stated number is left as it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def not_broadcast(df: DataFrame) -> DataFrame:
    """A join side whose rows come from a generator (``explode``, ``inline``), joined by sorting.

    Spark estimates a generator's output at the size of its input, and would send a table of a row a deal, seat and
    strain to the driver and to every executor as if it were as small as the table of sessions it grew from.
    """
    return df.hint("merge")


def own_shuffle(df: DataFrame, *keys: str) -> DataFrame:
    """A join side that grew on the join's keys, shuffled on its own all the same (its names and rows stay as they are).

    Adaptive execution splits a hot key's partition only where both sides of a join are plain shuffles.
    """
    return df.withColumns({c: F.array_max(F.array(c)) for c in keys})


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, by_rows: bool = True) -> DataFrame:
    """Read one parquet table (optionally only some columns), spread over the cluster's cores.

    A large table that is shuffled by key at once needs no tasks of a stated number of rows: without ``by_rows`` it is dealt out
    only if it comes in fewer splits than there are cores, and is not written to disk once more.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return spread(df, df.count() if by_rows else 0)  # from the files' footers
