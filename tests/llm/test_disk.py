"""What the near-duplicate stage shuffles."""

import random

from pyspark.sql import functions as F

from boardlake.llm import common, ngram_join


def test_texts_nobody_asks_for_are_not_shuffled(spark, capsys):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    ids = spark.createDataFrame([(i,) for i in range(0, 5000, 100)], "id long")
    held = common.by_bits(docs, F.col("doc_id"), common.key_bits(ids, "id"), True)
    rest = common.by_bits(docs, F.col("doc_id"), common.key_bits(ids, "id"), False)
    assert held.columns == rest.columns == docs.columns
    few = {r["doc_id"] for r in held.collect()}
    assert few >= set(range(0, 5000, 100)) and len(few) < 60 and held.count() + rest.count() == 5000
    texts = ngram_join.texts_of(docs, ids)
    assert sorted(r["id"] for r in texts.collect()) == list(range(0, 5000, 100))
    capsys.readouterr()
    texts.explain()
    assert "kb_word" in capsys.readouterr().out


def test_one_of_each_with_copies_repeated_and_null_ids(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(40)) for _ in range(30)) for _ in range(40)]
    rows = [(i, base[i % 30]) for i in range(60)] + [(100 + i, base[i] + " more") for i in range(10)] + [(7, base[35]), (7, base[7]), (101, base[36]), (200, None), (201, ""), (202, "one two")]
    docs = spark.createDataFrame([*rows, (None, base[0]), (None, base[0]), (None, None)], "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in ngram_join.one_of_each(docs, 5, 80).collect())
    of = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_components(docs.where("doc_id is not null"), 5, 80).collect()}
    assert got == sorted([(False, i) for i, c in of.items() if c == i] + [(True, 0)] * 3)
