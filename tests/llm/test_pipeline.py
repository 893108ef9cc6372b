"""Every stage beside the operator's own decisions, and the pipeline from end to end."""

import corpus_pipeline as cp
from test_duplicates import lower, plain_components, plain_fingerprint
from tallyfloor.llm import kneser_ney, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents, labels):
    docs = documents
    rejected = {r["doc_id"] for r in kneser_ney.classify(docs, labels).where("NOT kept").collect()}
    docs = cp.STAGES[0][1](spark, docs, SF)
    ids = {r["doc_id"] for r in docs.collect()}
    assert docs.columns == documents.columns and ids == {r["doc_id"] for r in documents.collect()} - rejected
    failed = {r["doc_id"] for r in quality_rules.judge(docs, labels).where("NOT kept").collect()}
    docs = cp.STAGES[1][1](spark, docs, SF)
    rows = docs.collect()
    assert docs.columns == documents.columns and {r["doc_id"] for r in rows} == ids - failed
    best = {}
    for r in rows:
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    docs = cp.STAGES[2][1](spark, docs, SF)
    rows = docs.collect()
    assert docs.columns == documents.columns and sorted(r["doc_id"] for r in rows) == sorted(best.values())
    stay = sorted(set(plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]).values()))
    docs = cp.STAGES[3][1](spark, docs, SF)
    assert docs.columns == documents.columns and sorted(r["doc_id"] for r in docs.collect()) == stay
    assert {r["doc_id"] for r in cp.STAGES[4][1](spark, docs, SF).collect()} == set(stay)


def test_stages_on_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count() if name != "packing" else True
            assert name == "packing" or out.columns == docs.columns


def test_classifier_judges_rows_by_their_own_text(spark, odd, odd_rows, labels):
    """Rows without an id, and rows that share one, each go or stay by their own verdict, whatever the quantile rejects."""
    from collections import Counter

    kept = {bytes(r["mark"]) for r in kneser_ney.classify(odd, labels, marked=True, quantile=0.05, slack=0.0).where("kept").collect()}
    every = odd.select(*odd.columns, kneser_ney.mark().alias("mark_of_row")).collect()
    want = Counter((r["doc_id"], r["text"]) for r in every if bytes(r["mark_of_row"]) in kept)
    got = Counter((r["doc_id"], r["text"]) for r in kneser_ney.filtered(odd, labels, quantile=0.05, slack=0.0).collect())
    assert got == want and 0 < sum(got.values()) <= len(odd_rows)
    marks = {(r["doc_id"], r["text"] or "", r["lang"]): bytes(r["mark_of_row"]) for r in every}
    assert len(set(marks.values())) == len(marks)


def test_run(spark):
    rows = cp.run(spark, SF).collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(rows[0].asDict())
