"""What the pipeline's Python workers and the executors around them hold."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boardlake.llm import common, quality, token_files

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbound(spark):
    """The session without a bound of its own; what others set is put back."""
    old = spark.conf.get(BOUND, None)
    spark.conf.unset(BOUND)
    yield spark
    spark.conf.unset(BOUND)
    if old is not None:
        spark.conf.set(BOUND, old)


def sizes_of(docs):
    """(n, size) of every Arrow batch."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    return common.map_batches(docs, run, "n long, size long").collect()


def test_batches_are_bounded_in_bytes(unbound):
    docs = unbound.range(6000).coalesce(1).select(F.concat(F.repeat(F.lit("word "), 700), F.col("id").cast("string")).alias("text"))
    got = sizes_of(docs)
    assert sum(r["n"] for r in got) == 6000 and len(got) > 9
    assert max(r["size"] for r in got) <= common.BATCH_BYTES + 4000


def test_a_session_keeps_its_own_bound(unbound):
    unbound.conf.set(BOUND, "64k")
    docs = unbound.range(300).coalesce(1).select(F.repeat(F.lit("word "), 700).alias("text"))
    got = sizes_of(docs)
    assert unbound.conf.get(BOUND) == "64k" and len(got) > 9 and sum(r["n"] for r in got) == 300


def test_token_files_ask_for_bounded_batches(unbound):
    docs = unbound.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert token_files.encoded(docs, token_files.default_vocabulary()).count() == 2
    assert int(unbound.conf.get(BOUND).rstrip("b")) == common.BATCH_BYTES


def test_statistics_and_moments_are_not_one_stage(spark, sf, capsys):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train = quality.labelled(quality.training_features(docs), labels)
    assert train.count()
    capsys.readouterr()
    train.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_small_caches_give_the_same_ids(monkeypatch):
    from pathlib import Path

    model = Path(token_files.default_vocabulary()).read_text(encoding="utf-8")
    texts = [f"Word{i} caf\xe9 {i % 7}{i} it's zq{i * i}x" for i in range(60)] * 2
    usual = token_files.Encoder(model)
    want = [usual(t) for t in texts]
    monkeypatch.setattr(token_files, "HALF", 3)
    few = token_files.Encoder(model)
    assert [few(t) for t in texts] == want and len(few.old) < 30
    whole = [usual.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(memoryview(w).cast("I")) for w in want] == whole


def test_a_worker_keeps_one_encoder(spark, monkeypatch):
    from pathlib import Path

    from pyspark import cloudpickle

    model = Path(token_files.default_vocabulary()).read_text(encoding="utf-8")
    tasks = []
    monkeypatch.setattr(token_files, "map_batches", lambda df, run, schema: tasks.append(run))
    token_files.encoded(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), token_files.default_vocabulary())
    names = tasks[0].__code__.co_names
    assert "worker_encoder" in names and "_worker" not in names and "Encoder" not in names
    sent = cloudpickle.loads(cloudpickle.dumps(token_files.worker_encoder))
    assert sent is token_files.worker_encoder and sent(model) is sent(model)
