from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import index as I, retrieve as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_slugs_and_paths(spark):
    assert one(spark, T.slug(F.lit("  Hello, World! "))) == "hello_world"
    assert one(spark, T.slug(F.lit("!!"))) == "untitled"
    assert one(spark, T.predicate_name(F.lit("!!"))) == ""
    assert one(spark, T.lookup_path(F.lit("..Memory..People.."))) == "memory.people"
    assert one(spark, T.lookup_path(F.lit("My Notes. Q & A"))) == "my_notes.q_a"
    assert one(spark, T.lookup_path(F.lit("  "))) == "untitled"
    path = T.build_lookup_path(F.lit("memory/ops/Run Books.md"), F.array(*map(F.lit, ["Run books", "A", "B", "C", "D"])))
    assert one(spark, path) == "memory.ops.run_books.a.b.c"
    assert one(spark, T.parent_path(F.lit("a.b.c"))) == "a.b" and one(spark, T.parent_path(F.lit("a"))) is None


def test_terms(spark):
    assert one(spark, T.terms(F.lit("The quick, the QUICK fox 12 and 345"))) == ["quick", "quick", "fox", "345"]
    assert one(spark, T.significant_terms(F.lit("foo_bar is foo_bar of what Bar"))) == ["foo_bar", "bar"]
    assert one(spark, T.query_tokens(F.lit("What follow-up 2024 is Next?"))) == ["followup", "next"]
    assert one(spark, T.asked_predicates(F.lit("cancelled the forget"))) == ["phone", "company"]
    assert one(spark, T.subject_tokens(F.lit("Which Slack channel does Alice Smith use"))) == ["which", "slack", "alice", "smith"]
    assert one(spark, T.overlap(F.lit("Alpha beta"), F.array(F.lit("alp"), F.lit("zzz")))) == 0.5
    assert T.safe_text("“Café” — naïve…") == '"Café" - naïve...'
    labels = [(v["ord"], v["label"], v["op"]) for v in one(spark, T.query_variants(F.lit("What is Alice Smith's phone")))]
    assert labels == [(1, "fts_exact", "and"), (2, "fts_keywords", "and"), (3, "fts_or", "or"), (4, "fts_name", "and")]
    assert one(spark, T.token_count(F.lit(""))) == 1 and one(spark, T.token_count(F.lit("abcde"))) == 2


def test_facts_take_the_first_value(spark):
    text = "- Name: Ann\n- Email: a\n* email : b\n1. Not: this\n- Empty:\nKey: no"
    chunks = spark.createDataFrame([(1, "p.q", text)], "chunk_id long, lookup_path string, content string")
    rows = {(r["subject"], r["predicate"], r["object"]) for r in I.facts(chunks).collect()}
    assert rows == {("Ann", "name", "Ann"), ("Ann", "email", "a")}


def test_bm25_agrees_with_sqlite(spark):
    """sqlite's own full-text index ranks alike, also for repeated terms and phrases."""
    import sqlite3

    texts = ["red fox jumps over red fence", "the fox sleeps", "blue fence and foo bar", "bar foo red", "foo bar foo bar fox", "nothing here"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(content)")
    db.executemany("insert into f(rowid, content) values (?, ?)", list(enumerate(texts, 1)))
    chunks = spark.createDataFrame(list(enumerate(texts, 1)), "chunk_id long, content string")
    index = I.Index(chunks, None, None, None, I.postings(chunks), None, None)
    asked = [(1, "and", ["red", "fox"]), (2, "or", ["fox", "fence"]), (3, "and", ["foo_bar"]), (4, "and", ["fox", "fox"])]
    wanted = spark.createDataFrame([(i, 1, op, t) for i, op, t in asked], "query_id long, variant int, op string, terms array<string>")
    got = {(r["query_id"], r["chunk_id"]): r["bm25"] for r in I.bm25(index, wanted).collect()}
    want = {}
    for i, op, terms in asked:
        q = (" OR " if op == "or" else " ").join('"' + t.replace("_", " ") + '"' for t in terms)
        want |= {(i, r): -s for r, s in db.execute("select rowid, bm25(f) from f where f match ?", (q,))}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_budget_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(1, 1, 500), (1, 2, 600), (1, 3, 200), (2, 1, 1500)], "query_id int, rank int, token_count long")
    rows = {(r["query_id"], r["rank"]) for r in R.token_budget(hits, 1200, ["query_id"], [F.col("rank")]).collect()}
    assert rows == {(1, 1), (1, 2)}


def test_words_within_are_those_of_a_loop(spark):
    words = sorted({"war", "warm", "foo_bar", "bar", "r_b", "2024", "o_ba"})
    texts = ["Warmth of foo_bar2024", "İ waŕm", "xWARMx", "foo bar", "", None, "ab" * 50 + "war" + "z" * 50, "war-m foo_\nbar"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.words_within("t", words).alias("at"), F.lower("t").alias("low")).collect()
    for r in rows:
        assert r["at"] == (None if r["low"] is None else [i for i, w in enumerate(words) if w in r["low"]])
    assert one(spark, T.words_within(F.lit("war"), [])) == []
