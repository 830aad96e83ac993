from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import parent_path, token_count
from quarry.operators import index as I, retrieve as R, segments as G

WORDS = "oak elm ash walrus seal crab launch email phone Dana Whit billing hosts garden river stone".split()


def chunk_rows(spark, rows):
    """Chunks of (id, path, order, content, file)."""
    df = spark.createDataFrame(rows, "chunk_id long, lookup_path string, chunk_order int, content string, source_file string")
    return df.withColumns({"parent_path": parent_path("lookup_path"), "source": F.lit("file"), "token_count": token_count("content"), "start_line": F.lit(1), "end_line": F.lit(1)})


def content(draw):
    lines = [" ".join(draw.choice(WORDS) for _ in range(draw.randrange(1, 12))) for _ in range(draw.randrange(1, 4))]
    return "\n".join(lines + [f"- {draw.choice(['Name', 'Email', 'Review'])}: {draw.choice(WORDS)} {draw.randrange(9)}" for _ in range(draw.randrange(3))])


def _asked(ix):
    asked = [(k, 200, [], w) for k, w in enumerate((["oak"], ["da", "whit"], ["is", "hi"], ["email"], ["st", "ton"]))]
    return ix.chunks.sparkSession.createDataFrame(asked, "query_id int, limit int, predicates array<string>, subjects array<string>")


def tables(ix):
    told = lambda df, *cols: sorted((tuple(round(v, 4) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*cols).collect()), key=str)
    return {
        "chunks": told(ix.chunks, "chunk_id", "lookup_path", "chunk_order", "content"), "paths": told(ix.paths, "lookup_path", "parent_path", "depth", "chunk_count", "child_count"),
        "terms": told(ix.terms, "term", "lookup_path", "weight"), "facts": told(ix.facts, "chunk_id", "subject", "predicate", "object"),
        "persons": told(R.fact_hits(ix, _asked(ix)), "query_id", "chunk_id"),
        "postings": told(ix.postings, "term", "chunk_id", "tf", "dl", "positions"), "vocab": told(ix.vocab, "term", "df"), "sizes": told(ix.sizes, "n", "avgdl"),
    }


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "chunk_id long, access_count long, last_accessed timestamp"), spark.createDataFrame([], "subject string, predicate string, object string")


@pytest.mark.parametrize("seed, tier", [(1, 8), (2, 3)])
def test_changes_come_to_what_a_full_build_gives(spark, none, tmp_path, monkeypatch, seed, tier):
    """Random changes (new, replaced, moved and deleted chunks), with merges of segments in between."""
    monkeypatch.setattr(G, "TIER", tier)
    draw, store, have, version = random.Random(seed), G.Store(spark, f"file://{tmp_path}/ix"), {}, None
    for step in range(6):
        ids = draw.sample(range(30), draw.randrange(1, 8))
        dead = [i for i in ids if i in have] + draw.sample([i for i in have if i not in ids], min(2, len([i for i in have if i not in ids])))
        new = {i: (i, draw.choice(("a", "a.b", "a.b.c", "d.e")), draw.randrange(4), content(draw), f"f{i % 5}.md") for i in ids}
        gone = store.alive(version, "chunks").where(F.col("chunk_id").isin(dead)) if version and dead else None
        version = store.compacted(store.change(version, chunk_rows(spark, list(new.values())), gone))
        have = {i: r for i, r in have.items() if i not in dead} | new
    assert len(version.segments) < 6 if tier == 3 else len(version.segments) == 6
    full = I.build(chunk_rows(spark, list(have.values())), *none)
    assert tables(store.index(version, *none)) == tables(full)


def test_a_small_change_writes_little_and_readers_keep_their_version(spark, none, tmp_path):
    draw = random.Random(3)
    store = G.Store(spark, f"file://{tmp_path}/ix")
    first = store.change(None, chunk_rows(spark, [(i, f"p.q{i % 50}", i, content(draw), "f.md") for i in range(2000)]))
    reader = store.index(first, *none)
    before = tables(reader)
    second = store.change(first, chunk_rows(spark, [(9999, "p.q7", 99, "a narwhal came", "g.md")]), reader.chunks.where("chunk_id = 7"))
    own = G.Version(second.number, second.segments[-1:])
    rows = {name: store.table(own, name).count() for name in G.SCHEMAS}
    assert rows["chunks"] == rows["dead_chunks"] == rows["dead_paths"] == 1 and rows["blocks"] == 3 and rows["paths"] <= 2 and rows["terms"] <= I.PATH_TERMS
    assert tables(reader) == before
    after = store.index(store.latest(), *none)
    assert {r["chunk_id"] for r in after.chunks.collect()} == {*range(2000), 9999} - {7}
    # a second writer of the same version is refused, and its change can be made anew
    with pytest.raises(G.Conflict):
        store.change(first, chunk_rows(spark, [(8888, "p.z", 0, "late", "h.md")]))
    tries = []
    third = store.attempt(lambda v: store.change(tries.append(v) or (first if len(tries) == 1 else v), chunk_rows(spark, [(8888, "p.z", 0, "late", "h.md")])))
    assert third.number == 3 and len(tries) == 2 and [v.number for v in tries] == [2, 2]
    # what refused writers left goes, once it is old enough that no writer can be at it
    assert store.vacuum(1) == 0 and store.vacuum(1, seconds=0) == 2 and store.numbers() == [3]
    assert store.index(store.latest(), *none).chunks.count() == 2001


@pytest.mark.parametrize("op", ["or", "and"])
def test_bounds_leave_no_hit_out(spark, none, tmp_path, op):
    draw = random.Random(5)
    rows = [(i, "a.b", i, " ".join(draw.choices(WORDS, weights=[60, 40, 30, 20, 10, 8, 6, 5, 4, 3, 2, 2, 2, 1, 1, 1], k=draw.randrange(3, 40))), "f.md") for i in range(1500)]
    store = G.Store(spark, f"file://{tmp_path}/ix")
    version = store.change(None, chunk_rows(spark, rows[:1200]))
    version = store.change(version, chunk_rows(spark, rows[1200:]), store.alive(version, "chunks").where("chunk_id % 97 = 0"))
    ix = store.index(version, *none)
    asked = spark.createDataFrame([(k, 1, op, draw.sample(WORDS[:14], draw.randrange(1, 5)) + (["oak"] if k % 3 else []), draw.choice((1, 5, 40))) for k in range(20)] + [(99, 1, op, ["oak_elm", "stone"], 5), (98, 1, op, ["nowhere"], 5)], "query_id long, variant int, op string, terms array<string>, k int")
    best = lambda df: {q: sorted(((-round(s, 9), c) for _, c, s in rows), key=lambda x: x)[: k[q]] for q, rows in by(df).items()}
    k = {r["query_id"]: r["k"] for r in asked.collect()}

    def by(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["query_id"], []).append((r["query_id"], r["chunk_id"], r["bm25"]))
        return out

    full, top = I.bm25(ix, asked.drop("k")), I.bm25_top(ix, asked)
    assert best(top) == best(full)
    if op == "or":
        assert top.count() < full.count()


def test_variants_asked_one_by_one_find_the_same(spark, none, tmp_path):
    """Later variants for open queries only, by bounds, against all variants in one pass; some queries below a path."""
    from quarry.operators import retrieve as R

    draw = random.Random(8)
    rows = [(i, draw.choice(("a", "a.b", "c.d")), i, content(draw), "f.md") for i in range(300)]
    store = G.Store(spark, f"file://{tmp_path}/ix")
    ix = store.index(store.change(None, chunk_rows(spark, rows)), *none)
    asked = [(k, " ".join(draw.sample(WORDS, draw.randrange(1, 5))), 3, 2000, draw.choice((None, "", "a"))) for k in range(8)] + [(9, "Dana Whit walrus launch", 4, 2000, None), (10, "the", 3, 2000, None)]
    q = spark.createDataFrame(asked, "query_id long, query string, limit int, max_tokens int, path_prefix string")
    found = [sorted(tuple(r) for r in R.text_search(ix, q, F.lit("2024-01-01").cast("timestamp"), one_pass=n).select("query_id", "rank", "chunk_id", "score", "stage").collect()) for n in (-1, 1 << 40)]
    assert found[0] == found[1] and len({r[0] for r in found[0]}) >= 9
