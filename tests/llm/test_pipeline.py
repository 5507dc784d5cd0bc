"""The pipeline's stages, each against its own input."""

import pytest
from pyspark.sql import functions as F
from samples import SCHEMA

import __spark_entry__ as entry
import corpus_pipeline as cp
from eraflow.llm import langid, pipeline
from eraflow.llm.common import store
from test_decontam import direct as contaminated
from test_neardup import direct as grouped


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_registered():
    assert [name for name, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "token_files"]
    queries = entry.queries()
    assert "pipeline" in queries and all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11))


def test_language_stage_keeps_prose_and_drops_noise(spark, docs, sf_dir):
    noise = spark.createDataFrame([(10**6, "12 34 !!", "en", "a", 8), (10**6 + 1, None, None, "a", 0)], SCHEMA)
    kept = pipeline.known_language(spark, docs.unionByName(noise), sf_dir)
    assert kept.columns == docs.columns
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert not ids & {10**6, 10**6 + 1} and len(ids) >= 0.99 * docs.count()


def test_near_duplicate_stage(spark, docs, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted(d for d, n, c in grouped(rows) if d == c)
    kept = pipeline.without_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want


def test_decontamination_stage(spark, docs, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(d for d, _, hit, _ in contaminated(rows, items) if not hit)
    kept = pipeline.without_benchmark(spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want


def test_mixing_stage(spark, docs, sf_dir):
    out = pipeline.mixed(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}
    total = [x.agg(F.sum(F.length("text"))).first()[0] for x in (out, docs)]
    assert 0.5 < total[0] / total[1] < 1.6


def test_whole_run(spark, sf_dir):
    got = cp.run(spark, sf_dir).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_token_files_keep_the_order_of_the_mix(spark, docs, sf_dir, folder):
    mix = store(pipeline.mixed(spark, docs, sf_dir), folder)
    order = [r["doc_id"] for r in mix.select("doc_id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    got = [r["doc_id"] for r in pipeline.token_files(spark, mix, sf_dir).orderBy("start").collect()]
    assert got == order and got != sorted(got)
    # copies of a document do not stand side by side, and shares by source hold in the files
    beside = sum(a == b for a, b in zip(got, got[1:], strict=False))
    assert beside < 0.05 * len(got)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    half = len(got) // 2
    shares = [sum(source[d] == s for d in part) / len(part) for s in set(source.values()) for part in (got[:half], got[half:])]
    assert all(abs(a - b) < 0.2 for a, b in zip(shares[::2], shares[1::2], strict=True))


def test_every_stage_takes_odd_and_empty_tables(spark, odd, none, sf_dir, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 3)
    for frame in (odd, none):
        for _, stage in cp.STAGES:
            stage(spark, frame.withColumn("extra", F.lit(1)), sf_dir).count()
