"""The pipeline's stages, each on what the stage before kept."""

import corpus_pipeline
from neuroloom.llm import pii, quality

from .test_corpus import plain_join

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.collect()
        now = corpus_pipeline.staged(stage(spark, now, SF), name)
        assert now.columns == names
        after = {r.doc_id: r for r in now.collect()}
        if name == "quality":
            judged = {r.doc_id: quality.judged(r.text or "", 0.3) for r in before}
            assert {d: r.text for d, r in after.items()} == {d: j[7] for d, j in judged.items() if j[6]}
        elif name == "near_duplicates":
            assert set(after) == {d for d, _, c in plain_join([(r.doc_id, r.text) for r in before], 5, 80) if d == c}
        else:
            assert {d: r.text for d, r in after.items()} == {r.doc_id: pii.redact(r.text, pii.spans(r.text)) for r in before}
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {p.doc_id for p in pieces} == set(after) and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeats, clashing columns, a table without the other columns, and an empty one."""
    from .data import TEXTS, table

    odd = table(spark, TEXTS + TEXTS[-4:] + ["one two three four five six seven eight nine ten eleven twelve, write to a@b.example now."] * 2)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd, odd.select("text", "doc_id"), odd.limit(0)):
        rows = docs.collect()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, docs, SF)
            assert now.columns == names
            after = now.collect()
            if name == "quality":
                assert sorted(r.text for r in after) == sorted(j[7] for r in rows if (j := quality.judged(r.text or "", 0.3))[6])
            elif name == "near_duplicates":
                want = [d for d, _, c in plain_join([(r.doc_id, r.text) for r in rows], 5, 80) if d == c and d is not None]
                assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(want)
            else:
                assert sorted((r.text or "") for r in after) == sorted(pii.redact(r.text or "", pii.spans(r.text or "")) for r in rows)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert sum(p.start == 0 for p in pieces) == len(rows)
