"""The stages of the pipeline, each against a plain version on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, awkward, pairs
from tests.llm.test_similar_texts import brute as similar

SF = "/root/testdata/sf0.001"


def stayed(rows):
    """One text of each group of near duplicates: the smallest id, nulls last. Groups whose least id stands for several texts are left to the caller."""
    group = {}
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    for (i, _), (_, c) in zip(numbered, similar(numbered), strict=True):
        group.setdefault(c, []).append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in group.values()]


@pytest.mark.parametrize("source", ["documents", "awkward"])
def test_stages(spark, source):
    if source == "documents":
        docs = spark.read.parquet(f"{SF}/documents.parquet")
    else:  # nulls, empty and long texts, repeated rows, and extra columns with names that operators use
        docs = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
        docs = docs.withColumns({c: F.lit(7) for c in ("_key", "base", "spans", "_spans", "_text", "n_hit", "items", "contaminated", "sig", "fp", "component_id", "kept", "llr", "taken", "target", "n_chars", "_rows", "_f0", "_prefix", "__id", "__key", "__spans", "__words", "_stays", "__row", "__kept", "_id", "c0", "c1", "_hit", "_best")})
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF)
        if name != "mix":
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(kept.collect(), kept.schema).repartition(2)
        b, k = pairs(before), None if name == "mix" else pairs(kept)
        if name == "dedup":
            assert sorted(map(repr, k)) == sorted(map(repr, stayed(b)))
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert sorted(map(repr, k)) == sorted(repr(p) for p, r in zip(b, brute.contamination(b, items), strict=True) if not r[-1])
        elif name == "pii":
            assert len(b) == len(k) and not any(brute.base_pii(t) for _, t in k) and kept.where("n_chars <> length(text)").count() == 0
        elif name == "quality":
            good = {repr(p) for p, r in zip(b, brute.quality(b), strict=True) if not r[-1]}
            assert {repr(p) for p in k} <= good and len(k) > 0.5 * len(good)
        if source == "awkward" and name == "quality":  # the stages after it get the awkward rows too
            kept = docs
    assert kept.count() > 0


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0.5 * docs.count() < len(rows) < docs.count() and len({r["doc_id"] for r in rows}) == len(rows)


def test_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
