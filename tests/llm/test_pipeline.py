import re

import corpus_pipeline
from evalguard.llm import common, decontaminate, jaccard_join, textvec

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, small_docs):
    docs, seen = small_docs, []
    for name, stage in corpus_pipeline.STAGES:
        new = common.materialise(stage(spark, docs, SF), "test-stage")
        seen.append((docs, new))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert new.columns == small_docs.columns
        docs = new
    (_, lang), (before, single), (_, clean), (unmixed, mixed), (_, tokens) = seen
    assert lang.count() == small_docs.where(common.letters(small_docs["text"])).count()
    found = jaccard_join.classes(single)
    assert single.count() < before.count() and found.where("class_size > 1").count() == 0
    assert single.count() == jaccard_join.classes(before).select("class_id").distinct().count()
    assert decontaminate.marked(clean, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in unmixed.collect()}
    assert tokens.count() == mixed.count()


def test_odd_documents_pass_all_stages(spark, odd, odd_rows):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs.select(*docs.columns), SF), "test-odd")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == odd.columns
    key = lambda x: (x is None, x)
    texts: dict = {}
    for r in odd_rows:
        if any(c.isalpha() for c in r[1] or ""):
            texts.setdefault(shingles(r[1]), []).append(r[0])
    groups = []  # near copies by brute force: here only equal sets and one changed word in 120
    for s, ids in texts.items():
        near = next((g for g in groups if len(s & g[0]) >= 0.8 * len(s | g[0])), None)
        near[1].extend(ids) if near else groups.append((s, list(ids)))
    want = sorted((min(ids, key=key) for _, ids in groups), key=key)
    assert sorted({r["doc_id"] for r in docs.collect()}, key=key) == sorted(set(want), key=key)


def shingles(text):
    w = re.findall(textvec.WORD_PATTERN, text.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_an_empty_table_stays_empty(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs.select(*docs.columns), SF), "test-empty")
        assert docs.count() == 0


def test_intermediates_go_once_a_result_is_written(spark, small_docs):
    before = len(common._written)
    kept = common.settle(spark, lambda: jaccard_join.keep_one(small_docs), "test-settled")
    assert len(common._written) == before + 1 and kept.count() < small_docs.count()


def test_documents_without_letters_go_whatever_their_label(spark):
    rows = [(i, "the cat sat on the mat and looked at the dog", "en") for i in range(9)] + [(20, "12 345 %%", "und"), (21, "678 &&", "en"), (22, "the dog sat on the mat", "und"), (23, "90", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    assert kept == {**dict.fromkeys(range(9), "en"), 22: "en"}
