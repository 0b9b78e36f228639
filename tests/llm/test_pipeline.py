import pytest

import corpus_pipeline
from ledgerloom.llm import near_dedup, pii, quality

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        if name != "packing":
            assert result.columns == start.columns
        docs = result.cache()
        seen.append((name, docs.count(), docs))
    counts = {n: c for n, c, _ in seen}
    assert start.count() > counts["quality"] > counts["near_dedup"] == counts["pii"] <= counts["packing"]
    kept, deduped, masked, packed = (d for _, _, d in seen)
    # No two kept documents are near-duplicates, and no kept one was dropped without a kept twin.
    comps = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(kept).collect()}
    assert {r.doc_id for r in deduped.collect()} == {k for k, (_, keep) in comps.items() if keep}
    assert pii.span_digests(masked).selectExpr("sum(n_email + n_ip + n_card + n_phone) as n").first().n == 0
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in masked.select("doc_id").collect()}
    assert all(r.n_chars == len(r.text) for r in masked.collect())


def test_run_equals_the_stages_one_by_one(spark):
    got = {(r.doc_id, r.part, r.length) for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert got == {(r.doc_id, r.part, r.length) for r in docs.collect()}


def test_clean_labelled_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.keep_good(docs, labels).select("doc_id")
    good, bad = labels.filter("quality = 1"), labels.filter("quality = 0")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()
    assert bad.join(kept, "doc_id", "left_semi").count() <= 0.05 * bad.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    stage(spark, docs, SF).count()
    assert stage(spark, docs.limit(0), SF).count() == 0
