"""What several operators of this subpackage need: tables, checkpoints, label folds."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Words ``[^\x20\x09-\x0D]+`` as the SQL functions take them.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder that the cluster names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts lineage, survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bits of a table of keys: 2 MB, whatever the keys.
KEY_BITS = 24


def _slot(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - KEY_BITS)


def key_bits(keys: DataFrame, name: str) -> DataFrame:
    """(kb_word, kb_bits): a table of ``2 ** KEY_BITS`` bits, at most one row for 64 of them, with the bits of the keys' hashes set."""
    slots = keys.select(_slot(F.col(name)).alias("kb_slot"))
    return slots.groupBy(F.shiftright("kb_slot", 6).alias("kb_word")).agg(F.expr("bit_or(shiftleft(1L, cast(kb_slot & 63 as int)))").alias("kb_bits"))


def by_bits(df: DataFrame, key: Column, bits: DataFrame, held: bool) -> DataFrame:
    """Rows whose key's bit is set (``held``: all rows of the keys and some more), or the others, without a shuffle of the rows.

    What is broadcast has a fixed size; many keys set many bits, so the filter gets weaker, never wrong.
    """
    rows = df.withColumn("kb_slot", _slot(key))
    same = (F.shiftright("kb_slot", 6) == F.col("kb_word")) & F.expr("kb_bits & shiftleft(1L, cast(kb_slot & 63 as int)) <> 0")
    return rows.join(F.broadcast(bits), same, "left_semi" if held else "left_anti").drop("kb_slot")


def smallest(df: DataFrame, n: int, *order) -> list:
    """The first n rows in an order.  Each task keeps n rows, one task merges them; the driver gets n rows in all."""
    return saved(df.orderBy(*order).limit(n)).collect()


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """A function over Arrow batches that gives its freed memory back at the end of each task."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


#: Bytes of the Arrow batches that go to Python workers; the row that passes the bound is in.
BATCH_BYTES = 2 << 20


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` of ``giving_back(run)`` over batches of few bytes, whatever the size of a text.

    Spark's default is 10,000 rows or 64 MB: of long texts a task's executor holds that outside its heap, and the worker
    once more.  A bound that the session sets itself stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df.mapInArrow(giving_back(run), schema)


def id_crc(col: Column) -> Column:
    """crc32 of the id as text; 0 for a null id."""
    return F.coalesce(F.crc32(col.cast("string")), F.lit(0))


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label): ids with one agreed label of 0 or 1; nulls and contradictions are left out."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1))
    return (good.groupBy("doc_id").agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
            .where("lo = hi").select("doc_id", F.col("lo").cast("int").alias("label")))
