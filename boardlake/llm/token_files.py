"""Operator 3, token-ID output: ORC files of token ids, in ascending doc_id order.

Whole texts are dealt by ranges of doc_id and sorted, then encoded and written at once, one file
a range: ids as an integer array (ORC run-length encodes it), with the number of ids and the
running start within the file.  The files carry row indexes and Bloom filters on ``doc_id``, so a
lookup of ids reads only stripes that may hold them, and any stripes can be read in parallel.
A document's global start is the files' totals before its file (one row per file) plus its start there.

Texts are encoded by the tokenizers library.  A vocabulary of the default's kind (NFC, lower case, its
split pattern, byte-level BPE) encodes each run of letters or marks apart, so for texts in printable Latin-1
without the beginning of a special token the runs are found here, the library's BPE model encodes each new run, and
runs already seen come from a bounded cache.  All other texts and vocabularies are encoded whole.  The test
compares both ways.

Defined results: a null or empty text has the end id alone; rows that repeat a doc_id stand next to each
other, by hash and order of their texts; a null id comes first; an empty table gives an empty file set.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import map_batches, shared_path

END_ID = 1
#: Rows between two entries of the row index, bytes of a stripe, false positives of the Bloom filters.
ROW_INDEX, STRIPE, FALSE_POSITIVES = 1000, 16 << 20, 0.01
#: Runs in either half of a worker's cache; when the young half is full it becomes the old one.
HALF = 200_000
_SCHEMA = "part int, doc_id long, start_in_part long, n_tokens int, ids array<int>"
_worker: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The split pattern of the default vocabulary, and the same over lower-case Latin-1.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS, _SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r "
_RUN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


#: Beginnings of special tokens, controls, and all beyond printable Latin-1.
_ODD = re.compile("<\\||[\x00-\x08\x0e-\x1f\x7f-\xa0\xad\u0100-\U0010ffff]")


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter of every byte: printable ones are their own, the others follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b if b in printable else 256 + others.index(b) for b in range(256)}


class Encoder:
    """Ids of whole texts, as little-endian 32-bit integers."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        spec = json.loads(model)
        self.tokenizer = Tokenizer.from_str(model)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_runs = ([x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in split] == ["Split", "ByteLevel"]
                        and split[0]["pattern"] == {"Regex": SPLIT} and split[0]["behavior"] == "Removed" and split[0]["invert"]
                        and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
                        and all(x["content"].startswith("<|") for x in spec["added_tokens"]))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenizer.model.tokenize(run)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if not self.by_runs or _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.young) > HALF:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        runs = _RUN.findall(text.lower())
        for r in set(runs):
            if r not in young:
                young[r] = old[r] if r in old else self._run(r)
        return b"".join([young[r] for r in runs])


def worker_encoder(model: str) -> Encoder:
    """The one encoder of a Python worker.  A function of the module, which workers import: functions inside others are sent with
    copies of the module's names they use, so a cache used there would be a new one in every task."""
    if _worker.get("key") != (key := zlib.crc32(model.encode())):
        _worker.clear()  # before the next is made
        _worker.update(key=key, encoder=Encoder(model))
    return _worker["encoder"]


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows of the files, in their order.  The vocabulary file is read on the driver and sent along."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(model.value), np.array([END_ID], "<u4").tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                ids = [encoder(t or "") + end for t in b.column("text").to_pylist()]
                off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), b.column("doc_id"), pa.array(start + off[:-1]),
                                                  pa.array(np.diff(off).astype(np.int32)), wh.list_array(flat, off, pa.int32())],
                                                 ["part", "doc_id", "start_in_part", "n_tokens", "ids"])
                start += int(off[-1])

    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tf_tie", F.xxhash64("text"))
    order = order.repartitionByRange("doc_id", "tf_tie").sortWithinPartitions("doc_id", "tf_tie", "text")
    return map_batches(order.select("doc_id", "text"), run, _SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write the ORC files of all documents to a new folder."""
    (encoded(docs, vocabulary or default_vocabulary()).write
     .option("compression", "zstd").option("orc.row.index.stride", ROW_INDEX).option("orc.stripe.size", STRIPE)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", FALSE_POSITIVES).orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, start_in_part, n_tokens, ids.  Filters on doc_id prune stripes and row groups."""
    return spark.read.schema(_SCHEMA).orc(path)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    files = read_tokens(spark, path)
    before = Window.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (files.groupBy(F.col("part").alias("of_part")).agg(F.sum("n_tokens").alias("total"))  # one row per file
             .select("of_part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            off = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            n = np.diff(off).astype(np.int64)
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), b.column("start_in_part"), pa.array(n), pa.array(crc, pa.int64())],
                                             ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])

    rows = map_batches(files.select("part", "doc_id", "start_in_part", "ids"), run, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    return (rows.join(parts, rows["part"] == parts["of_part"])
            .select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"))


def tokenized(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write all documents to new files in the shared folder and return their digests from there."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary)
    return token_digests(docs.sparkSession, path)
