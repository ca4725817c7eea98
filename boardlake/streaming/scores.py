"""Structured Streaming operators.

T2 lands new result files incrementally: a file source with a checkpoint; every micro-batch keeps
the results whose id has not landed before, however late they arrive, and appends them to the landed
table.  T1 counts the scores of just these rows and appends the counts; a board's running frequencies are the
sums over the epochs.  Each epoch writes its own folder and overwrites it when it is run again, so a
query that stops at any point resumes from its checkpoint without losing or doubling a result.
All paths lie under one root folder that the caller names and keeps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder (for runs that need not be resumed)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stream_files(spark: SparkSession, path: str, schema: StructType, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over parquet files landing in ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def land_and_count(stream: DataFrame, id_cols, k, score: str, root: str) -> DataFrame:
    """Land what has arrived and return the frequency table (k..., score, n) of all that landed.

    The ids landed before are found by a join with the landed table's id columns, so nothing is kept in
    state and no late row is lost.
    """
    ids, k = list(id_cols), [k] if isinstance(k, str) else list(k)
    root = root.rstrip("/")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in ids]
        new = batch.groupBy(*ids).agg(F.min(F.struct(*rest)).alias("_r")).select(*ids, "_r.*")
        if epoch > 0:
            known = spark.read.parquet(f"{root}/landed").filter(F.col("epoch") < epoch).select(*ids)
            new = new.join(known, ids, "left_anti")
        new.write.mode("overwrite").parquet(f"{root}/landed/epoch={epoch}")
        landed = spark.read.schema(new.schema).parquet(f"{root}/landed/epoch={epoch}")
        counts = landed.filter(F.col(score).isNotNull()).groupBy(*k, score).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{root}/counts/epoch={epoch}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{root}/counts").groupBy(*k, score).agg(F.sum("n").alias("n"))


def land_within(stream: DataFrame, id_cols, event_time: str, delay: str, k, score: str, root: str, grain: str = "day") -> DataFrame:
    """T1, T2 by event time: like ``land_and_count``, with work an epoch bounded by the delay instead of the history.

    The watermark of an epoch is the largest event time of the epochs before it less ``delay`` (an interval such as
    ``'2 days'``).  Rows older than it, or without an event time, go to the side table ``late`` and are not counted.  The others are compared
    only with what landed on the dates from the watermark on: the landed table is partitioned by event date
    (the beginning of a ``grain``: day, month ...), so earlier partitions are not read.  A result delivered again thus either meets itself there or is late: it is never counted twice.
    """
    ids, k = list(id_cols), [k] if isinstance(k, str) else list(k)
    root = root.rstrip("/")
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in ids]
        once = batch.groupBy(*ids).agg(F.min(F.struct(*rest)).alias("_r")).select(*ids, "_r.*")
        mark = None
        if epoch > 0:
            mark = spark.read.parquet(f"{root}/marks/epoch={epoch - 1}").select(F.expr(f"seen - INTERVAL {delay}").alias("mark")).first()["mark"]  # one row
        t = F.col(event_time)
        on_time = t.isNotNull() if mark is None else t.isNotNull() & (t >= F.lit(mark))
        once.where(~on_time).write.mode("overwrite").parquet(f"{root}/late/epoch={epoch}")
        new = once.where(on_time).withColumn("event_date", F.to_date(F.date_trunc(grain, t)))
        if mark is not None:
            new = new.join(landed_since(spark, root, schema, mark, epoch, grain).select(*ids), ids, "left_anti")
        new.hint("rebalance", F.col("event_date")).write.mode("overwrite").partitionBy("event_date").parquet(f"{root}/landed/epoch={epoch}")
        landed = spark.read.schema(schema).parquet(f"{root}/landed/epoch={epoch}")
        counts = landed.filter(F.col(score).isNotNull()).groupBy(*k, score).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{root}/counts/epoch={epoch}")
        seen = batch.agg(F.max(event_time).alias("seen"))
        if epoch > 0:
            seen = seen.unionByName(spark.read.parquet(f"{root}/marks/epoch={epoch - 1}")).agg(F.max("seen").alias("seen"))
        seen.coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/epoch={epoch}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{root}/counts").groupBy(*k, score).agg(F.sum("n").alias("n"))


def landed_since(spark: SparkSession, root: str, schema: StructType, mark, epoch: int, grain: str = "day") -> DataFrame:
    """What landed in earlier epochs on the mark's date or later; earlier dates are pruned as partitions."""
    whole = StructType([*schema.fields]).add("epoch", "integer").add("event_date", "date")
    return spark.read.schema(whole).parquet(f"{root}/landed").where((F.col("epoch") < epoch) & (F.col("event_date") >= F.to_date(F.date_trunc(grain, F.lit(mark)))))
