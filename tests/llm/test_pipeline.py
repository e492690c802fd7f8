"""The pipeline's stages, and the text queries next to their SQL twins."""

from __future__ import annotations

import pytest

import corpus_pipeline
from sparkrecon.llm import crf, queries
from tests.llm import brute
from tests.oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    status, detail = compare(spark, duck(FOLDER), name, queries.QUERIES[name], queries.ORACLES.get(name), FOLDER)
    assert status in ("OK", "ROWS"), detail


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert seen[name].columns == columns
        docs = seen[name]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter(~queries.held_out())
    everything = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scores = crf.score(everything, crf.train(everything, labels)).collect()
    good = {r["doc_id"] for r in scores if r["score"] >= crf.THRESHOLD}
    assert {r["doc_id"] for r in seen["quality"].collect()} == good

    rows = [(r["doc_id"], r["text"]) for r in seen["quality"].collect()]
    keep = {c for _, _, c in brute.jaccard_components(rows)}
    assert sorted(r["doc_id"] for r in seen["near_duplicates"].collect()) == sorted(keep)

    redacted = seen["personal_data"].collect()
    assert sorted(r["doc_id"] for r in redacted) == sorted(keep)
    assert not any(brute.base_spans(r["text"]) for r in redacted)
    assert all(len(r["text"]) == r["n_chars"] for r in redacted)

    mixed = seen["mix"].groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in mixed} <= keep and max(r["count"] for r in mixed) <= 3
    packed = seen["packing"].groupBy("doc_id").agg({"length": "sum"}).count()
    assert packed == len(mixed)


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    again = corpus_pipeline.run(spark, FOLDER)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, again.select(columns).collect()))
