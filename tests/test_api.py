from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from quarry.api import Engine, EngineError, envelope, results, savings_line
from quarry.operators import retrieve as R
from quarry.sources.config import Settings



def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


NOTES = {
    "MEMORY.md": "# Memory\n\n## Facts\n\n- Home network: BlueBarn-7G\n- Alert channel: #deploy-room\n",
    "memory/people/index.md": "# People\n\n## Work\n\n- Name: Dana Whit\n- Email: dana@mill.test\n- Role: lead of networking\n",
    "memory/projects/oak.md": "# Oak\n\n## Milestones\n\n- Launch date: 2031-05-06\n- Review: each Monday\n\n## Scope\n\nThe oak project moves billing to new hosts.\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, Settings()).build(spark.createDataFrame(list(NOTES.items()), "path string, text string"))


@pytest.mark.parametrize("question, answer", [("home network name", "BlueBarn-7G"), ("Which alert channel", "#deploy-room"), ("What is Dana Whit email", "dana@mill.test"), ("oak launch date", "2031-05-06")])
def test_answers_are_found(engine, question, answer):
    assert any(answer in r["snippet"] for r in engine.search(question, 3, now=now()).collect())


def test_paths(engine):
    kind, rows = engine.lookup("memory.projects.oak", now=now())
    assert kind == "path" and {r["lookup_path"] for r in rows.collect()} == {"memory.projects.oak.milestones", "memory.projects.oak.scope"}
    assert [r["lookup_path"] for r in engine.path_root().collect()] == ["memory"]
    pages, cursor = [], None
    while page := engine.path_children("memory", cursor, 1).collect():
        pages.append(page[0]["lookup_path"])
        cursor = page[0]["next_cursor"]
    assert pages == ["memory.facts", "memory.people", "memory.projects"]


def test_saves_relations_and_errors(spark, engine):
    saves = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "the zebra password is kept", "notes.zoo", None)], "save_id long, ts timestamp, content string, path string, heading string")
    own = Engine(spark, Settings(), engine.index, engine.manifest).save(saves).relate("notes.zoo", "concerns", "memory.projects.oak.scope")
    hits = own.search("zebra", 5, now=now()).collect()
    assert hits[0]["lookup_path"] == "notes.zoo" and ("memory.projects.oak.scope", "concerns") in {(r["lookup_path"], r["via_relation"]) for r in hits}
    with pytest.raises(EngineError):
        own.search(" ")
    with pytest.raises(EngineError):
        own.relate("a", " ", "b")
    found = envelope(own.path_root(), time.time())
    assert found["ok"] and found["data"]["items"]
    assert own.savings(own.search("zebra", 1, now=now())).first()["tokens_saved"] >= 0


def test_prompt_context(engine):
    text = engine.prompt_context("oak launch date", now=now())
    assert text.startswith("[Memory context]") and "2031-05-06" in text


def test_accents_are_folded(spark):
    """Accented words as a full-text index of SQLite tells them."""
    import sqlite3

    notes = {"a.md": "# A\n\n## Voc\n\nThe naïveté of the café owner.\n", "b.md": "# B\n\n## Voc\n\nPlain words of the garden.\n"}
    own = Engine(spark, Settings()).build(spark.createDataFrame(list(notes.items()), "path string, text string"))
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x)")
    db.executemany("insert into t values (?)", [(x,) for x in notes.values()])
    for word in ("naivete", "naïveté", "café", "cafe", "garden"):
        there = len(db.execute("select rowid from t where t match ?", (word,)).fetchall())
        assert len({r["lookup_path"] for r in own.search(word, 5, now=now()).collect()}) >= there == 1
    terms = {r["term"] for r in own.index.postings.select("term").distinct().collect()}
    assert {"naivete", "cafe"} <= terms and not {"nai", "vete"} & terms


def test_refresh_parses_what_changed(spark, engine):
    own = Engine(spark, Settings(), engine.index, engine.manifest)
    notes = {k: v for k, v in NOTES.items() if "oak" not in k} | {"MEMORY.md": "# Memory\n\n## Facts\n\n- Home network: RedBarn-9\n", "new.md": "# New\n\n## Part\n\nA walrus came by.\n"}
    own.refresh(spark.createDataFrame(list(notes.items()), "path string, text string"))
    text = " ".join(r["content"] for r in own.index.chunks.collect())
    assert "RedBarn-9" in text and "BlueBarn-7G" not in text and "walrus" in text and "billing" not in text and "dana@mill.test" in text
    assert {r["path"] for r in own.manifest.collect()} == set(notes)


def test_blank_saves_are_refused(spark, engine):
    saves = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "  ", "notes.zoo", None)], "save_id long, ts timestamp, content string, path string, heading string")
    with pytest.raises(EngineError) as e:
        Engine(spark, Settings(), engine.index, engine.manifest).save(saves)
    assert e.value.code == "INVALID_CONTENT"


def test_searches_and_fetches_are_recorded(spark, engine):
    own = Engine(spark, Settings(), engine.index, engine.manifest)
    before = {r["chunk_id"]: r["access_count"] for r in own.index.access.collect()}
    hit = own.search("oak launch date", 1, now=now()).first()
    assert (hit["path"], hit["reason"] in R.REASONS) == ("memory/projects/oak.md", True)
    own.fetch(hit["chunk_id"], now=now())
    own.lookup("memory.projects.oak.milestones", now=now())
    after = {r["chunk_id"]: r["access_count"] for r in own.index.access.collect()}
    assert after[hit["chunk_id"]] - before.get(hit["chunk_id"], 0) == 3
    quiet = Engine(spark, Settings(), engine.index, engine.manifest, record=False)
    quiet.search("oak launch date", 1, now=now())
    assert not quiet.logs


def test_replacing_and_repeated_saves(spark, engine):
    schema = "save_id long, ts timestamp, content string, path string, heading string"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    own = Engine(spark, Settings(), engine.index, engine.manifest)
    for k, (s, text) in enumerate([(0, "a walrus"), (30, "a walrus"), (60, "a walrus"), (61, "a seal")]):
        own.save(spark.createDataFrame([(k, at(s), text, "notes.sea", None)], schema))
    here = lambda: sorted((r["chunk_order"], r["content"]) for r in own.index.chunks.where("lookup_path = 'notes.sea'").collect())
    assert here() == [(0, "a walrus"), (1, "a walrus"), (2, "a seal")]
    own.save(spark.createDataFrame([(7, at(62), "a crab", "notes.sea", None), (8, at(63), "a seal", "notes.sea", None)], schema), replace=True)
    assert here() == [(0, "a seal")]


def test_runs_are_audited_and_unchanged_files_cost_nothing(spark):
    files = spark.createDataFrame(list(NOTES.items()), "path string, text string")
    own = Engine(spark, Settings()).build(files)
    index = own.index
    own.refresh(files)
    assert own.index is index
    own.refresh(spark.createDataFrame([(k, v + "\n- More: yes\n") for k, v in NOTES.items() if "oak" not in k], "path string, text string"))
    runs = own.logs["index_runs"].orderBy("started_at").collect()
    assert [(r["scope"], r["files_scanned"], r["files_changed"]) for r in runs] == [("full", 3, 3), ("changed", 3, 0), ("changed", 2, 2)]
    assert [(r["chunks_added"] > 0, r["chunks_deleted"] > 0) for r in runs] == [(True, False), (False, False), (True, True)]


def test_get_gates_savings_and_results(spark, engine, tmp_path):
    (tmp_path / "n.md").write_text("a\nb\nc\n")
    own = Engine(spark, Settings(), engine.index, engine.manifest)
    assert own.get("n.md", 2, 1, root=str(tmp_path)).first()["text"] == "b"
    with pytest.raises(EngineError):
        own.get("../n.md", root=str(tmp_path))
    assert own.prompt_context("oak", now=now()) == own.prompt_context("oak launch date", now=now(), trigger="cron") == ""
    hits = own.search("oak launch date", 2, now=now())
    first, second = own.record_savings(hits), own.record_savings(hits)
    assert second["total_tokens_saved"] == first["tokens_saved"] + second["tokens_saved"]
    assert savings_line({"total_tokens_saved": 42300, "total_cost_avoided": {"x": 0.2115}}) == "42,300 tokens saved (x: $0.2115 avoided)"
    told = results(hits)
    assert told["results"] and told["fallback"] is False and not set(R.INTERNAL) & set(told["results"][0])


def test_roots_that_are_missing_have_no_files(spark, tmp_path):
    (tmp_path / "MEMORY.md").write_text("# Memory\n\n## Part\n\n- A walrus: yes\n")
    own = Engine(spark, Settings(roots=[str(tmp_path / "none"), str(tmp_path)])).build()
    assert own.manifest.count() == 1 and own.index.chunks.count() == 1


SAVE = "save_id long, ts timestamp, content string, path string, heading string"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_saved_accents_are_found(spark, engine):
    """Composed and decomposed words, saved and asked for, one by one and in a batch."""
    own = Engine(spark, Settings(), engine.index, engine.manifest, record=False)
    own.save(spark.createDataFrame([(1, at(0), "Our pi\u00f1ata holds a xylophone", "notes.fete", None), (2, at(1), "A cre\u0300me bru\u0302le\u0301e", "notes.dessert", None)], SAVE))
    for word, path in (("xylophone", "notes.fete"), ("pinata", "notes.fete"), ("pi\u00f1ata", "notes.fete"), ("pin\u0303ata", "notes.fete"), ("cr\u00e8me", "notes.dessert"), ("brulee", "notes.dessert")):
        assert own.search(word, 3, now=now()).first()["lookup_path"] == path
    asked = spark.createDataFrame([(1, "pi\u00f1ata", 5, 1200, None), (2, "brul\u00e9e", 5, 1200, "notes")], "query_id long, query string, limit int, max_tokens int, path_prefix string")
    assert {(r["query_id"], r["lookup_path"]) for r in own.search_many(asked, now()).where("rank = 1").collect()} == {(1, "notes.fete"), (2, "notes.dessert")}


def test_queued_saves_come_as_one_change(spark, engine):
    own = Engine(spark, Settings(), engine.index, engine.manifest, record=False)
    own.DEBOUNCE_MS = 60_000
    before = own.version.number
    for k in range(4):
        own.save(spark.createDataFrame([(k, at(100 * k), f"kelp number {k}", "notes.kelp", None)], SAVE), wait=False)
    assert own.store.latest() is None and own._timer is not None
    assert [r["chunk_order"] for r in own.index.chunks.where("lookup_path = 'notes.kelp'").orderBy("chunk_order").collect()] == [0, 1, 2, 3]
    assert own.version.number == before + 1
    own.DEBOUNCE_MS = 500
    own.save(spark.createDataFrame([(9, at(900), "late kelp", "notes.kelp", None)], SAVE), wait=False)
    deadline = time.time() + 60
    while own.store.latest().number == before + 1 and time.time() < deadline:
        time.sleep(0.2)
    assert own.store.latest().number == before + 2


def test_an_engine_goes_on_from_its_folder(spark, tmp_path):
    place = f"file://{tmp_path}/ix"
    first = Engine.open(spark, Settings(), place)
    assert first.search("oak", now=now()).collect() == []
    first.build(spark.createDataFrame(list(NOTES.items()), "path string, text string")).relate("notes.zoo", "concerns", "memory.projects.oak.scope")
    first.save(spark.createDataFrame([(1, at(0), "the zebra is kept", "notes.zoo", None)], SAVE))
    hit = first.search("zebra", 1, now=now()).first()
    again = Engine.open(spark, Settings(), place)
    assert again.version == first.version and set(again.logs) == {"accesses", "saved", "relations", "index_runs"}
    assert again.index.access.where(f"chunk_id = {hit['chunk_id']}").first()["access_count"] == 1
    again.save(spark.createDataFrame([(2, at(30), "the zebra is kept", "notes.zoo", None)], SAVE))  # within 60 seconds of what the other one saved
    assert again.index.chunks.where("lookup_path = 'notes.zoo'").count() == 1
    assert ("memory.projects.oak.scope", "concerns") in {(r["lookup_path"], r["via_relation"]) for r in again.search("zebra", 5, now=now()).collect()}
    # the first engine reads its own version until it is asked to look again
    again.refresh(spark.createDataFrame([(k, v) for k, v in NOTES.items() if "oak" not in k], "path string, text string"))
    assert first.index.chunks.where("source_file like '%oak%'").count() > 0 == first.reopen().index.chunks.where("source_file like '%oak%'").count()


def test_unchanged_files_are_not_opened(spark, tmp_path):
    import os

    root = tmp_path / "notes"
    names = ["MEMORY.md", "memory/a b.md", "memory/c+d%20.md", "memory/x/[1].md", "memory/x/n.md"]
    for k, n in enumerate(names):
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(f"# T{k}\n\n## Part\n\nA walrus of kind {k}.\n")
    own = Engine(spark, Settings(roots=[str(root)]), record=False).build()
    assert {r["path"] for r in own.manifest.collect()} == set(names) and own.index.chunks.count() == 5
    from quarry.sources import files as S

    plan = S.listed(spark, str(root), ["**"], [])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    # what a look at size and time can't tell isn't seen: the file wasn't opened
    stat = os.stat(root / "memory/x/n.md")
    (root / "memory/x/n.md").write_text("# T4\n\n## Part\n\nA badger of kind 4.\n")
    os.utime(root / "memory/x/n.md", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    version = own.version
    assert own.refresh().version == version and "badger" not in " ".join(r["content"] for r in own.index.chunks.collect())
    os.utime(root / "memory/x/n.md", ns=(stat.st_atime_ns, stat.st_mtime_ns + 5_000_000_000))  # now it is
    os.utime(root / "MEMORY.md", ns=(stat.st_atime_ns, stat.st_mtime_ns + 5_000_000_000))  # another time, the same text: noted, not parsed
    (root / "memory/a b.md").unlink()
    own.refresh()
    text = " ".join(r["content"] for r in own.index.chunks.collect())
    assert "badger" in text and "kind 1" not in text and "kind 0" in text and {r["path"] for r in own.manifest.collect()} == set(names) - {"memory/a b.md"}
    runs = own.logs["index_runs"].orderBy("started_at").collect()
    assert [(r["scope"], r["files_scanned"], r["files_changed"], r["chunks_added"], r["chunks_deleted"]) for r in runs] == [("full", 5, 5, 5, 0), ("changed", 5, 0, 0, 0), ("changed", 4, 1, 1, 2)]


def test_logs_stay_few_files(spark, tmp_path, monkeypatch):
    from quarry.operators import logs

    monkeypatch.setattr(logs, "TAIL", 4)
    log = logs.Log(spark, f"file://{tmp_path}/log", "chunk_id long, n long", lambda rows: rows.groupBy("chunk_id").agg(F.sum("n").alias("n")))
    reader = None
    for k in range(11):
        rows = log.append(spark.createDataFrame([(k % 2, 1), (7, 1)], log.schema))
        reader = reader or rows
        assert {r["chunk_id"]: r["n"] for r in rows.groupBy("chunk_id").agg(F.sum("n").alias("n")).collect()} == {c: n for c, n in ((0, k // 2 + 1), (1, (k + 1) // 2), (7, k + 1)) if n}
    assert len(list((tmp_path / "log").iterdir())) <= 9 and log.rows().count() <= 3 + 2 * 3


def test_ranges_of_large_files_read_little(spark, tmp_path, monkeypatch):
    from quarry.sources import files as S

    lines = [f"line {k} " + "w" * (k % 90) for k in range(40_000)]
    (tmp_path / "big.md").write_text("\n".join(lines))
    own = Engine(spark, Settings(), path=f"file://{tmp_path}/ix")
    read, plain = [], S.read_bytes
    monkeypatch.setattr(S, "read_bytes", lambda spark, location, at, n: (read.append(n), plain(spark, location, at, n))[1])
    for first, n in ((20_000, 3), (40_000, 9), (1, 1)):
        row = own.get("big.md", first, n, root=str(tmp_path)).first()
        assert row["text"] == "\n".join(lines[first - 1 : first - 1 + n]) and (row["from_line"], row["n_lines"]) == (first, min(n, 40_001 - first))
    assert max(read) < 60_000
    made = []
    monkeypatch.setattr(S, "line_places", lambda *a: made.append(a))
    assert own.get("big.md", 7, 1, root=str(tmp_path)).first()["text"] == lines[6] and not made  # the places are kept


def test_trace_and_snippet_length(spark, engine):
    own = Engine(spark, Settings(snippet_chars=40), engine.index, engine.manifest, record=False)
    told = own.trace("What is Dana Whit email", now=now()).collect()
    assert told[0]["stage"] == "fact_index" and all(r["hits"] > 0 for r in told) and [r["ord"] for r in told] == sorted(r["ord"] for r in told)
    assert {"fts_or", "fts_name"} & {r["stage"] for r in told}
    _, rows = own.lookup("memory.projects.oak.milestones", now=now())
    assert {len(r["snippet"]) for r in rows.collect()} == {40}
