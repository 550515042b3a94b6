"""The pipeline's stages against what each should do to its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import near_dedup, pii, quality_rules

from .test_operators import SF, brute_components


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "near duplicates", "personal data", "packing"]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = corpus_pipeline.quality(spark, docs, SF).cache()
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    both = good & {r["doc_id"] for r in docs.collect()}
    assert len(both & left) >= 0.97 * len(both)
    ruled = corpus_pipeline.rules(spark, kept, SF).cache()
    bits = {r["doc_id"]: r["failed_bits"] for r in quality_rules.ledger(kept).collect()}
    assert {r["doc_id"] for r in ruled.collect()} == {i for i, b in bits.items() if not b & quality_rules.policy_mask("v1")}
    single = corpus_pipeline.near_duplicates(spark, ruled, SF).cache()
    want = brute_components([(r["doc_id"], r["text"]) for r in ruled.collect()], 80)
    assert {r["doc_id"] for r in single.collect()} == {c for _, c in want.values()}
    clean = corpus_pipeline.personal_data(spark, single, SF).cache()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {i: pii.redacted(t) for i, t in before.items()}
    packed = corpus_pipeline.pack(spark, clean, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(before)
    assert near_dedup.SHINGLE == 5


def test_run(spark):
    """The whole run equals its stages, one after the other; every kept document's tokens are there once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    tokens, want = {}, {}
    for r in rows:
        tokens.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        want[r["doc_id"]] = r["doc_tokens"]
    for i, pieces in tokens.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == want[i]


def test_odd_inputs(spark):
    """Every stage with nulls, empty and long texts, repeated rows, clashing extra columns, and no rows."""
    rows = [(1, "a b c d e f", None, "x", 0), (1, "a b c d e f", None, "x", 0), (2, None, "en", None, 1), (3, "", "en", "x", 2), (None, "a b c", "en", "y", 3), (4, "word " * 60_000, "en", "x", 4)]
    names = ("score", "kept", "cls", "comp", "_class", "_rule_bits", "n_words", "ids", "part", "_source", "x0", "queue")
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int").withColumns({c: F.lit(c) for c in names})
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            got = out.collect()
            assert docs is odd or got == []
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, odd, SF).collect()} == {1, 2, 3, 4, None}
