"""Texts of megabytes through every operator and every stage of the pipeline."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from skyloom.llm import bpe, exact_dedup, importance, language_model, license_scan, manifest, mixing, near_dedup, packing, pii, quality_rules, runs
from skyloom.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mixed(spark):
    """The documents of the small table, and beside them five texts of one to two megabytes, two of them alike."""
    words = " ".join(f"w{k}" for k in range(250_000))
    long = {
        900_001: words,
        900_002: words.replace("w17 ", "v17 "),
        900_003: "x" * 2_000_000,
        900_004: "mail me at some.one@example.org today\n" * 30_000,
        900_005: "é " * 500_000 + "MIT License 10.0.0.1",
    }
    rows = [(i, t, "en", "src0", len(t)) for i, t in long.items()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(4)
    return both, long, spark.read.parquet(f"{SF}/labels.parquet")


def one(df, i, *columns):
    return df.where(f"doc_id = {i}").select(*columns).collect()


def test_exact_and_near_duplicates(mixed):
    docs, long, _ = mixed
    found = exact_dedup.exact_dedup(docs)
    for i, t in long.items():
        assert [r[0] for r in one(found, i, "text_sha256")] == [hashlib.sha256(t.lower().encode()).hexdigest()]
    near = near_dedup.near_duplicates(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.where("doc_id > 900000").collect()}
    assert got[900_001] == (249_996, 900_001) and got[900_002] == (249_996, 900_001) and got[900_003] == (1, 900_003)


def test_scans_and_statistics(mixed):
    docs, long, labels = mixed
    found = one(license_scan.scan_licenses(docs), 900_005, "n_words", "base_labels", "first_word")
    assert [tuple(r) for r in found] == [(500_006, "mit", 500_000)]
    stats = quality_rules.quality_rules(docs, labels)
    assert [tuple(r) for r in one(stats, 900_004, "n_words", "n_dup_lines")] == [(150_000, 29_999)]
    spans = one(pii.find_pii(docs), 900_004, "base")
    assert len(spans[0]["base"]) == 30_000
    assert importance.resample(docs, labels).count() >= 0
    repeats = one(runs.find_runs(docs), 900_004, "runs", "collapsed")
    assert [tuple(x) for x in repeats[0]["runs"]] == [(0, 150_000, 5)] and repeats[0]["collapsed"] == "mail me at some.one@example.org today"


def test_tokens(mixed):
    docs, long, _ = mixed
    path = tokenizer_file("byte_bpe_50k.json")
    coded = bpe.decode_documents(bpe.encode_documents(docs.where("doc_id > 900000"), path), path)
    assert {r["doc_id"]: r["decoded"] for r in coded.collect()} == long
    pieces = packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json")).where("doc_id = 900001").collect()
    assert len(pieces) > 60 and sorted(r["start"] for r in pieces) == list(range(0, 4096 * len(pieces), 4096))


def test_language_model(mixed):
    docs, long, _ = mixed
    found = {r["doc_id"]: r for r in language_model.lm_scores(docs.where("doc_id < 100 or doc_id in (900003, 900004)")).collect()}
    assert found[900_003]["n_tokens"] == 2 and found[900_004]["n_tokens"] == 150_001 and found[900_004]["score"] < 0


def test_manifest_and_mixing(mixed):
    from pyspark.sql import functions as F

    docs, long, _ = mixed
    proofs = manifest.merkle_manifest(docs, F.when(F.col("doc_id") == 900_001, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    assert {r["doc_id"] for r in proofs.where("not verified").collect()} == {900_001}
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix_sources(docs).where("doc_id > 900000").collect()}
    assert sizes == {i: len(t.encode().split()) for i, t in long.items()}


def test_every_stage_of_the_pipeline(spark, mixed):
    docs, long, _ = mixed
    clean = lambda d: {r["doc_id"] for r in d.where("doc_id > 900000").select("doc_id").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept[name] = clean(out)
        if name == "pii":
            assert "[EMAIL]" in one(out, 900_004, "text")[0]["text"] and "some.one@" not in one(out, 900_004, "text")[0]["text"]
    assert kept["exact_dedup"] == set(long) and kept["minhash_near_dedup"] == set(long) - {900_002} and kept["pii"] == set(long) and kept["best_fit_packing"] == set(long)
    assert kept["quality_rules"] <= set(long)
