"""The stages on planted documents, each against what it must do."""

from __future__ import annotations

import pytest


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def test_run_on_the_small_tables(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "packing"]
    rows = corpus_pipeline.run(spark, sf).collect()
    room = {}
    for r in rows:
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert rows and max(room.values()) <= 1024


def test_language_stage_keeps_clean_documents(spark, sf, stages, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert stages["language"](spark, docs, sf).count() == docs.count()
    assert sorted(str(r.doc_id) for r in stages["language"](spark, odd_docs, sf).collect()) == ["1", "1", "2", "6", "None"]


def test_mixing_stage_repeats_documents(spark, stages, odd_docs, no_docs):
    out = stages["mixing"](spark, odd_docs, "")
    assert out.columns == odd_docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts and set(counts) <= {1, 2, 6, 7, None} and max(counts.values()) <= 4
    for name in ("language", "near_duplicates", "secrets", "mixing"):
        assert stages[name](spark, no_docs, "").columns == no_docs.columns
        assert stages[name](spark, no_docs, "").count() == 0


def test_every_stage_takes_odd_rows(spark, stages, odd_docs, sf):
    for name in ("near_duplicates", "secrets"):
        assert stages[name](spark, odd_docs, sf).columns == odd_docs.columns
    assert stages["packing"](spark, odd_docs, sf).where("piece = 0").count() == 10


NAMES = ["_id", "_hash", "_found", "_live", "_key", "_copy", "_copies", "_rows", "_content", "_deal", "_langid", "row", "key", "copies", "rows", "copy", "has", "hash", "found", "id", "live", "size", "band", "k", "t", "keep", "n", "content"]


def test_clashing_names_are_kept_as_they_are(spark, stages, odd_docs, sf):
    """Extra columns with the names of working columns: the same rows stay, and every extra value with them."""
    from pyspark.sql import functions as F

    secret = odd_docs.where("doc_id = 6").limit(1).withColumns({"doc_id": F.lit(8).cast("long"), "text": F.lit("password = Zx81kQ93bnM2 in here"), "n_chars": F.lit(30).cast("long")})
    docs = odd_docs.unionByName(secret)
    clashing = docs.withColumns({name: F.concat(F.lit(f"{name}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))) for name in NAMES})
    for name in ("language", "near_duplicates", "secrets", "mixing"):
        plain, out = stages[name](spark, docs, sf), stages[name](spark, clashing, sf)
        assert out.columns == clashing.columns, name
        rows = out.collect()
        assert sorted(map(str, plain.collect())) == sorted(str(r) for r in out.select(docs.columns).collect()), name
        assert all(r[c] == f"{c}-{'x' if r.doc_id is None else r.doc_id}" for r in rows for c in NAMES), name
    assert stages["packing"](spark, clashing, sf).where("piece = 0").count() == 11


def test_secrets_stage_masks_live_values(spark, stages):
    docs = spark.createDataFrame([(1, "password = Zx81kQ93bnM2 in here", "a", 31), (2, "nothing here", "a", 12), (3, None, None, None)], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in stages["secrets"](spark, docs, "").collect()}
    assert got[1][0].startswith("password = [SECRET]") or got[1][0].startswith("[SECRET]")
    assert got[1][1] == len(got[1][0]) and got[2] == ("nothing here", 12) and got[3] == (None, None)
