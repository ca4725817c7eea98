"""The pipeline's stages against brute force, and its guards."""

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from boardlake.llm import decontam, mixing, ngram_join, quality, token_files
from boardlake.llm.queries_llm import ORACLES, QUERIES

from .test_operators_llm import components, words

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows after every stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "token_output"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_classifier_stage(spark, sf, stages):
    scores = quality.quality_scores(stages[0], spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1")
    assert sorted(r["doc_id"] for r in scores.collect()) == sorted(r["doc_id"] for r in stages[1].collect())


def test_near_duplicate_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = sorted(i for i, (_, c) in components(rows, 5, 80).items() if c == i)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == want


def test_decontamination_stage(spark, sf, stages):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"], pattern)
        windows |= {tuple(w[i:i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = words(text, pattern)
        return not any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(r["doc_id"] for r in stages[2].collect() if clean(r["text"]))


def test_mixing_and_token_stages(stages):
    from tokenizers import Tokenizer

    plan = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mixing_plan(stages[3]).collect() if r["size"]}
    mixed = sorted(r["doc_id"] for r in stages[4].collect())
    assert mixed == sorted(i for i, n in plan.items() for _ in range(n))
    whole = Tokenizer.from_file(token_files.default_vocabulary())
    at = 0
    want = []
    for r in sorted(stages[4].collect(), key=lambda r: r["doc_id"]):
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in stages[5].collect()) == want


def test_registered_once_for_every_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_rest_imports_without_the_subpackage(tmp_path):
    """The entry module works where the subpackage and the pipeline are absent; nothing else imports them."""
    for p in ROOT.rglob("*.py"):
        relative = p.relative_to(ROOT)
        if "llm" in relative.parts or relative.name in ("corpus_pipeline.py", "__spark_entry__.py"):
            continue
        to = tmp_path / relative
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(p.read_text())
        assert "boardlake.llm" not in p.read_text() and "from ..llm" not in p.read_text()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"],
                          cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode == 0, said.stderr[-2000:]


def test_stages_with_odd_rows(spark, sf, tmp_path):
    """Null ids, nulls in every column, repeated rows, extra columns with internal names, and an empty table pass all stages."""
    base = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "only words here", None, None, 3), (-1, "", "en", "a", 0), (-2, None, "en", None, 0)] + [(-3, "a b c " * 40, "en", "a", 240)] * 5, base.schema)
    docs = base.limit(60).unionByName(odd)
    for c in ("dc_bad", "dc_key", "nj_id", "nj_gone", "nj_row", "mx_doc", "mx_size", "features", "tf_tie", "rep", "n"):
        docs = docs.selectExpr("*", f"'clash' AS {c}")
    for name, start in (("odd", docs), ("none", docs.limit(0))):
        rows, seen = start, [start.count()]
        for stage, f in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{stage}")
            f(spark, rows, sf).write.parquet(path)
            rows = spark.read.parquet(path)
            seen.append(rows.count())
            assert stage == "token_output" or rows.columns == start.columns
        assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and seen[-1] == seen[-2]
        assert (name == "odd") == bool(seen[-1])
