"""The pipeline on the smallest data: stage contracts, and the subpackage kept apart."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np

import corpus_pipeline
from shelfwise.llm import simhash

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == first.columns
            assert out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
        if k == 2:
            assert len({r.text for r in out.collect()}) == out.count()
        docs, before = out, docs
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [t for t in bench for r in before.collect() if r.text and t in r.text]
    ids = sum(len(np.frombuffer(r.ids, "<u4")) for r in docs.collect())
    assert ids == sum(r.length for r in docs.collect()) and docs.count() >= before.count()


def test_near_copies_go_by_fingerprint(spark):
    """One row stays of each component of linked fingerprints, whatever the similarity of the shingle sets."""
    rows = [(1, "a a a", "en", "s", 5), (2, "a " * 40 + "b", "en", "s", 81), (3, "c d e f g", "en", "s", 9), (4, "h i j k l", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [1, 3, 4]


def test_nothing_else_imports_it():
    for path in (ROOT / "shelfwise").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"shelfwise\.llm|corpus_pipeline", path.read_text()), path
