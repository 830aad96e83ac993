"""The pipeline's stages on a small corpus with hard rows, each against what it must do."""

from __future__ import annotations

import corpus_pipeline
from quarry.llm import session


def test_stages(spark, folder, rows):
    docs = session.documents(spark, folder)
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        docs = session.cut(stage(spark, docs, folder), f"stage{k}")
        if k < 4:
            assert docs.columns == columns
            seen[name] = before, {(r["doc_id"], r["text"]) for r in docs.collect()}
    before, after = seen["quality rules"]
    assert after < before and (900001, None) not in after
    before, after = seen["n-gram Jaccard join"]
    assert after <= before and len({t for _, t in after}) == len(after)
    before, after = seen["suffix-array dedup"]
    assert {i for i, _ in before} == {i for i, _ in after} and "�" not in "".join(t for _, t in after)
    before, after = seen["personal data"]
    assert {i for i, _ in before} == {i for i, _ in after} and not any("@mail" in t for _, t in after)
    pieces = docs.collect()
    assert {p["doc_id"] for p in pieces} == {i for i, _ in after}
    assert all(p["length"] * 4 == len(p["ids"]) for p in pieces)


def test_empty_tables(spark, none):
    assert corpus_pipeline.run(spark, none).collect() == []
