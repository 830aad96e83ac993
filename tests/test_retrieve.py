"""Snippets against a loop over all windows."""

from __future__ import annotations

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from quarry import tables
from quarry.operators import index as I, retrieve as R


def test_snippet_is_the_best_of_all_windows(spark):
    draw = random.Random(12)
    texts = [" ".join(f"w{k}" for k in range(78)) + " needle"]
    texts += [" ".join(draw.choice(("needle", *("hay",) * 9)) + str(k) for k in range(n)) for n in (1, 63, 64, 65, 66, 79, 80, 81, 200) for _ in range(3)]
    hits = spark.createDataFrame([(k, t, ["needle"]) for k, t in enumerate(texts)], "k int, content string, terms array<string>")
    got = {r["k"]: r["snippet"] for r in R.with_snippet(hits).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        n = [sum("needle" in x for x in w[s : s + 64]) for s in range(max(1, len(w) - 63))]
        s = n.index(max(n))
        want = t if len(w) <= 64 else ((" ... " if s else "") + " ".join(w[s : s + 64]) + (" ... " if s + 64 < len(w) else "")).strip()
        assert got[k] == want
    assert "needle" in got[0]


def test_facts_by_person_are_those_of_a_loop(spark):
    people = ["Dana Whit", "Al Bo", "Dan Whitaker", "Bo Al", "Ann Danah", None]
    facts = [(k, f"p.{k}", people[k % 6], "role" if k % 2 else "email", ("met dana whit", "x", "bo", "")[k % 4], 1.0) for k in range(24)]
    ix = SimpleNamespace(
        facts=spark.createDataFrame(facts, "chunk_id int, lookup_path string, subject string, predicate string, object string, weight double"),
        chunks=spark.createDataFrame([(k, f"p.{k}", 0) for k in range(24)], "chunk_id int, lookup_path string, chunk_order int"),
    )
    asked = [(1, 20, [], ["dana", "whit"]), (2, 20, [], ["al", "bo"]), (3, 20, [], ["dan"]), (4, 20, ["email"], ["bo"]), (5, 20, ["email", "role"], []), (6, 20, [], [])]
    q = spark.createDataFrame(asked, "query_id int, limit int, predicates array<string>, subjects array<string>")
    got = {(r["query_id"], r["chunk_id"]) for r in R.fact_hits(ix, q).collect()}
    want = set()
    for i, _, names, words in asked:
        for k, _, who, name, what, _ in facts:
            low = f"{who or ''}\n{what}".lower()
            if (names or words) and (not names or name in names) and all(w in low for w in words):
                want.add((i, k))
    assert got == want


def test_facts_by_the_kept_runs_are_those_of_a_loop(spark):
    """Random names and words; runs of chunks that are gone or have other facts by now find nothing more."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abn") for _ in range(draw.randrange(2, 6)))
    rows = [(k // 3, "p", None if k % 7 == 0 else f"{word().title()} {word()}é", f"k{k % 3}", " ".join(word() for _ in range(k % 4)) + ("" if k % 5 else "x" * 280), 1.0) for k in range(120)]
    schema = "chunk_id int, lookup_path string, subject string, predicate string, object string, weight double"
    facts = spark.createDataFrame(rows, schema)
    stale = spark.createDataFrame([(99, "p", "Abnab Nabba", "k", "banana", 1.0), (3, "p", "bannn", "k", "nnn", 1.0)], schema)
    chunks = spark.createDataFrame([(k, "p", k) for k in range(40)], "chunk_id int, lookup_path string, chunk_order int")
    ix = SimpleNamespace(facts=facts, chunks=chunks, grams=I.gram_index(facts).unionByName(I.gram_index(stale)))
    asked = [(i, 200, [], [word() for _ in range(1 + i % 3)]) for i in range(60)]
    q = spark.createDataFrame(asked, "query_id int, limit int, predicates array<string>, subjects array<string>")
    got = {(r["query_id"], r["chunk_id"]) for r in R.fact_hits(ix, q).collect()}
    want = {(i, r[0]) for i, _, _, words in asked for r in rows if all(w in f"{r[2] or ''}\n{r[4]}".lower() for w in words)}
    assert got == want and len(want) > 50
    none = facts.limit(0)
    empty = SimpleNamespace(facts=none, chunks=chunks, grams=I.gram_index(none))
    assert R.fact_hits(empty, q).count() == 0


def test_the_scan_of_runs_reads_what_is_wanted(spark, tmp_path):
    facts = spark.createDataFrame([(1, "p", "Dana Whit", "k", "x", 1.0)], "chunk_id int, lookup_path string, subject string, predicate string, object string, weight double")
    I.gram_index(facts).write.parquet(str(tmp_path / "grams"))
    asked = spark.createDataFrame([(1, ["dana", "wh"])], "query_id int, subjects array<string>")
    found = I.chunks_with(spark.read.parquet(str(tmp_path / "grams")), asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [ana,dan,wh])" in plan and [tuple(r) for r in found.collect()] == [(1, 1)]


def test_hits_are_ranked_without_their_texts(spark, sf):
    from quarry.plans import queries as Q

    stage = Q._stage(spark, sf)
    assert "content" not in stage.columns
    assert "content" not in stage._jdf.queryExecution().optimizedPlan().toString()
    best = Q._best_hits(spark, sf, 3)
    assert {r["rank"] for r in best.collect()} <= {1, 2, 3}
    texts = {r["doc_id"]: r["text"] for r in Q.table(spark, sf, "documents").collect()}
    assert all(texts[r["chunk_id"]] == r["content"] for r in best.collect())


def test_lookups_that_ask_alike_are_answered_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    chunk = "chunk_id long, lookup_path string, chunk_order int, token_count int, content string"
    chunks = spark.createDataFrame([(k, f"geo.a.c_{k:03d}", 0, 5, f"text {k}") for k in range(120)], chunk)
    ix = SimpleNamespace(
        chunks=chunks, paths=None, terms=spark.createDataFrame([], "term string, lookup_path string, weight double"),
        access=spark.createDataFrame([], "chunk_id long, access_count long, last_accessed timestamp"),
    )
    wanted = spark.createDataFrame([(q, "geo.a", 3, None) for q in range(50)] + [(50, "geo.a", 2, None), (51, None, 3, None), (52, "geo.a.c_007", 3, 4), (53, "geo.a.c_007", 3, 5)], "query_id int, path string, limit int, max_tokens int")
    ranked = []
    plain = R.top
    monkeypatch.setattr(R, "top", lambda df, n, by, *more: ranked.append(df.count()) or plain(df, n, by, *more))
    got = {}
    for r in R.path_lookup(ix, wanted, F.lit("2024-01-31").cast("timestamp")).collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert {q: sorted(v) for q, v in got.items()} == {q: [0, 1, 2] for q in range(50)} | {50: [0, 1], 53: [7]}
    assert ranked[0] == 240  # 120 chunks for each of two different asks, not for each of 51 queries


def test_terms_are_counted_in_tasks_of_bounded_chunks(spark, monkeypatch):
    monkeypatch.setattr(I, "TASK_CHUNKS", 10)
    chunks = spark.range(200).selectExpr("concat('a.b_', id) lookup_path", "concat('Word ', id, ' word') content")
    assert I.by_path(chunks).rdd.getNumPartitions() == 20
    rows = {(r["lookup_path"], r["term"]): r["n"] for r in I.term_frequencies(chunks).collect()}
    assert rows["a.b_7", "word"] == 2 and len(rows) == 200 + 100


def test_a_word_of_many_queries_is_met_once(spark):
    facts = spark.createDataFrame([(k, f"p.{k}", f"customer {k:04d}", "name", "france" if k % 2 else "peru", 1.0) for k in range(60)], "chunk_id long, lookup_path string, subject string, predicate string, object string, weight double")
    asked = spark.createDataFrame([(q, ["customer", "0042", "pe" if q % 2 else "fr"]) for q in range(30)], "query_id int, subjects array<string>")
    chosen, met = I.words_met(I.gram_index(facts), asked)
    assert {(r["query_id"], r["word"]) for r in chosen.collect()} == {(q, "0042") for q in range(30)}
    assert [(r["word"], r["chunk_id"]) for r in met.collect()] == [("0042", 42)]  # one row, not one for each query
    q = asked.selectExpr("query_id", "20 AS limit", "CAST(array() AS array<string>) AS predicates", "subjects")
    ix = SimpleNamespace(facts=facts, chunks=facts.selectExpr("chunk_id", "lookup_path", "0 AS chunk_order"), grams=None)
    assert {(r["query_id"], r["chunk_id"]) for r in R.fact_hits(ix, q).collect()} == {(q, 42) for q in range(1, 30, 2)}


def test_rows_that_cannot_be_held_are_made_once(spark, monkeypatch):
    """Of a table that may have too many rows to be held, no first rows are asked for before it is written."""
    monkeypatch.setattr(tables, "HELD_ROWS", 10)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(0, 100, 1, 2).repartition(2).mapInArrow(counted, "id long")
    table, n = tables.held(rows, "many", 1_000)
    assert (n, made.value) == (100, 100) and table.count() == 100
    few, n = tables.held(rows.where("id < 5"), "few")
    assert n == 5 and sorted(r["id"] for r in few.collect()) == [0, 1, 2, 3, 4]


def test_persons_of_many_words_are_those_of_a_loop(spark, monkeypatch):
    """Random words in random facts, asked in any order and several times: as by the table of runs, and as a loop has it, with and without a limit that cuts."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abné") for _ in range(draw.randrange(1, 5)))
    rows = [(k // 3, f"p.{k // 6:02d}", None if k % 7 == 0 else f"{word().title()} {word()}", f"k{k % 3}", word() if k % 4 else "", 1.0 + k % 2) for k in range(150)]
    facts = spark.createDataFrame(rows, "chunk_id int, lookup_path string, subject string, predicate string, object string, weight double")
    chunks = spark.createDataFrame([(k, f"p.{k // 2:02d}", 9 - k % 10) for k in range(48)], "chunk_id int, lookup_path string, chunk_order int")
    asked = [(i, 4 if i % 2 else 200, [], draw.choice([[word() for _ in range(1 + i % 4)], ["a", "n"], ["n", "a", "n"]])) for i in range(80)]
    q = spark.createDataFrame(asked, "query_id int, limit int, predicates array<string>, subjects array<string>")
    monkeypatch.setattr(R, "PUSHED_TERMS", 3)
    monkeypatch.setattr(I, "gram_index", None)  # no run of letters is asked for
    found = R.fact_hits(SimpleNamespace(facts=facts, chunks=chunks, grams=None), q).select("query_id", "chunk_id").collect()
    want, at = set(), {k: (f"p.{k // 2:02d}", 9 - k % 10) for k in range(48)}
    for i, limit, _, words in asked:
        fit = [r for r in rows if r[0] in at and all(w in f"{r[2] or ''}\n{r[4]}".lower() for w in words)]
        fit.sort(key=lambda r: (-r[5], *at[r[0]], r[0], r[3]))
        want |= {(i, r[0]) for r in fit[: max(12, 3 * limit)]}
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 200


def test_queries_that_ask_for_the_same_person_meet_facts_once(spark, monkeypatch):
    facts = spark.createDataFrame([(k, f"p.{k}", f"customer {k:04d}", "name", "france" if k % 2 else "peru", 1.0) for k in range(60)], "chunk_id long, lookup_path string, subject string, predicate string, object string, weight double")
    q = spark.createDataFrame([(k, 20, [], ["0042", "pe"] if k % 2 else ["pe", "0042"]) for k in range(40)], "query_id int, limit int, predicates array<string>, subjects array<string>")
    met, by_person = [], R._facts_by_person
    monkeypatch.setattr(R, "_facts_by_person", lambda *a: met.append(a[-1]) or by_person(*a))
    ix = SimpleNamespace(facts=facts, chunks=facts.selectExpr("chunk_id", "lookup_path", "0 AS chunk_order"), grams=None)
    assert {(r["query_id"], r["chunk_id"]) for r in R.fact_hits(ix, q).collect()} == {(k, 42) for k in range(40)} and met == [1]


def test_many_rows_in_small_files_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Files of equal rows are small however many rows they have; it is their number that counts."""
    spark.range(200_000).selectExpr("id", "'the same' AS path").write.option("compression", "zstd").parquet(str(tmp_path / "many"))
    many, few = spark.read.parquet(str(tmp_path / "many")).select("id"), spark.range(50_000).withColumn("x", F.rand(1))
    plan = lambda side: few.join(side, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(tables.sized(many, 100))
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 1 << 20)
    assert "BroadcastHashJoin" in plan(many) and "BroadcastHashJoin" not in plan(tables.sized(many, 100))
