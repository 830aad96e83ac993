from __future__ import annotations

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from quarry.operators import write as W
from quarry.sources import config, files as S
from quarry.streaming import jobs


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_saves_count_from_the_last_accepted(spark):
    rows = [(k, at(s), " same ") for k, s in enumerate((0, 40, 70, 100, 131))] + [(9, at(1), "other")]
    saves = spark.createDataFrame(rows, "save_id long, ts timestamp, content string")
    got = {r["save_id"] for r in W.accepted_saves(saves).where("accepted").collect()}
    assert got == {0, 2, 4, 9}


def test_stream_of_saves(spark, tmp_path):
    rows = [(k, at(s), "same") for k, s in enumerate((0, 40, 70, 100, 131))]
    spark.createDataFrame(rows, "save_id long, ts timestamp, content string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("save_id long, ts timestamp, content string").parquet(str(tmp_path / "in"))
    q = jobs.accepted(stream).writeStream.format("memory").queryName("accepted_saves").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r["save_id"] for r in spark.table("accepted_saves").collect()} == {0, 2, 4}


def test_stream_of_accesses(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select(F.col("user_id").alias("chunk_id"), "ts")
    q = jobs.accesses(stream).writeStream.format("memory").queryName("access_counts").option("checkpointLocation", str(tmp_path / "cp")).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("access_counts").collect()} == {tuple(r) for r in W.access_stats(spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("chunk_id"), "ts")).collect()}


def test_new_saves_come_next_in_order(spark):
    schema = "chunk_id long, lookup_path string, parent_path string, chunk_order int, source string, content string, token_count long, source_file string, start_line int, end_line int"
    chunks = spark.createDataFrame([(1, "a.b", "a", 0, "file", "x", 1, "f", 1, 1)], schema)
    saves = spark.createDataFrame([(1, at(0), "one", "a.b", None), (2, at(100), "two", "a.b", None), (3, at(5), "three", "", "My Head"), (4, at(6), " ", "", None)], "save_id long, ts timestamp, content string, path string, heading string")
    got = {(r["lookup_path"], r["chunk_order"], r["content"]) for r in W.save(chunks, saves).collect()}
    assert got == {("a.b", 0, "x"), ("a.b", 1, "one"), ("a.b", 2, "two"), ("agent_writes.session.my_head", 0, "three")}


def test_files_and_globs(spark, tmp_path):
    for name, text in {"MEMORY.md": "a", "memory/x/n.md": "b\nc\nd", "memory/my_secret.md": "s", "other/y.md": "o", "memory/z.txt": "t"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    s = config.load(None, {})
    rows = S.scan(spark, str(tmp_path), s.include_globs, s.exclude_globs)
    assert {(r["path"], r["text"]) for r in rows.collect()} == {("MEMORY.md", "a"), ("memory/x/n.md", "b\nc\nd")}
    wanted = spark.createDataFrame([("memory/x/n.md", 2, 9)], "path string, from_line int, n_lines int")
    assert [tuple(r) for r in S.line_range(rows, wanted).collect()] == [("memory/x/n.md", 2, 2, "c\nd")]
    log = tmp_path / "log.jsonl"
    log.write_text('{"role": "user", "content": "hi"}\nnot json\n')
    assert [(r["role"], r["content"]) for r in S.session_logs(spark, str(log)).collect()] == [("user", "hi")]


def test_settings(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('max_tokens_per_query = 0\nsnippet_chars = 10\ndb_path = "x"\n')
    s = config.load(str(f), {"QUARRY_ROOTS": "a,b"})
    assert (s.max_tokens_per_query, s.snippet_chars, s.roots, s.db_path) == (1, 40, ["a", "b"], str(tmp_path / "x"))
    assert config.load(str(tmp_path / "none"), {}).include_globs == config.load(None, {}).include_globs


def test_saves_of_one_content_are_folded_in_pieces(spark):
    """Against a loop; and no row holds all times of a content."""
    draw = random.Random(11)
    time, rows = 0, []
    for k in range(3000):
        time += draw.choice((0, 1, 20, 45, 59, 60, 200))
        rows.append((k, at(time), draw.choice("aaab")))
    saves = spark.createDataFrame(rows, "save_id long, ts timestamp, content string").repartition(5)
    want, last = set(), {}
    for k, t, c in rows:
        if c not in last or (t - last[c]).total_seconds() >= 60:
            last[c] = t
            want.add(k)
    df = W.accepted_saves(saves)
    assert {r["save_id"] for r in df.where("accepted").collect()} == want
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_state_of_saves_goes_with_the_watermark(spark, tmp_path):
    """A batch per file; late rows aren't taken, and a content that comes again after its span has no state left to be held against."""
    import json

    batches = [[(0, 0, "same"), (1, 40, "same"), (2, 70, "same"), (9, 1, "other")], [(3, 100, "same"), (4, 131, "same")], [(5, 400, "far")], [(6, 401, "same"), (7, 100, "late")], [(8, 4000, "end")]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("save_id long, ts timestamp, content string").json(str(tmp_path / "in"))
    q = jobs.accepted(stream).writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    held = []
    for k, rows in enumerate(batches):
        (tmp_path / "aside").write_text("".join(json.dumps({"save_id": i, "ts": at(s).isoformat(), "content": c}) + "\n" for i, s, c in rows))
        (tmp_path / "aside").rename(tmp_path / "in" / f"{k}.json")
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    assert {r["save_id"] for r in spark.table("expiring").collect()} == {0, 2, 4, 5, 6, 8, 9}
    assert held == [2, 1, 1, 2, 1]


def test_the_watcher_refreshes_and_repeats_nothing(spark, tmp_path):
    import time

    from quarry.api import Engine
    from quarry.sources.config import Settings

    root, place = tmp_path / "notes", f"file://{tmp_path}/ix"
    root.mkdir()
    (root / "MEMORY.md").write_text("# Memory\n\n## Part\n\nA walrus came by.\n")
    own = Engine(spark, Settings(roots=[str(root)]), record=False, path=place).build()
    first = own.version.number

    def until(change):
        q = jobs.watch(Engine.open(spark, own.settings, place), str(tmp_path / "cp"), 0.5)
        deadline = time.time() + 90
        while own.store.latest().number < change and time.time() < deadline and q.isActive:
            time.sleep(0.3)
        q.stop()
        return own.store.latest()

    (root / "MEMORY.md").write_text("# Memory\n\n## Part\n\nA badger came by instead.\n")
    then = until(first + 1)
    assert then.number == first + 1 and "badger" in own.reopen().index.chunks.first()["content"]
    # the batch that wrote is run again: its number is known, nothing is looked at
    (root / "MEMORY.md").write_text("# Memory\n\n## Part\n\nA narwhal and a seal came by.\n")
    assert own.refresh(batch=("watch", then.batches["watch"])).version.number == then.number
    # a watcher that begins again goes on with the next batch
    last = until(first + 2)
    assert last.number == first + 2 and last.batches["watch"] > then.batches["watch"] and "narwhal" in own.reopen().index.chunks.first()["content"]


def test_session_logs_have_true_lines_and_all_content(spark, tmp_path):
    """Also where Spark splits a file into blocks; a malformed line counts as a line, and content that is no string is its JSON."""
    said = [json.dumps({"role": "user", "content": f"line {k}"}) for k in range(1, 400)]
    said[6], said[9] = "not json", '{"role":"tool","content":[{"type":"text","text":"x"}]}'
    (tmp_path / "a.jsonl").write_text("\n".join(said) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in (old, "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            got = {r["turn"]: r["content"] for r in S.session_logs(spark, str(tmp_path)).collect()}
            assert 7 not in got and got[10] == '[{"type":"text","text":"x"}]' and len(got) == 398
            assert all(got[k] == f"line {k}" for k in got if k != 10)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _messages(n, seed):
    draw, out, t = random.Random(seed), [], {}
    for k in range(n):
        who = draw.choice(("a b", "a_b", "c", None))
        t[who] = t.get(who, 0) + draw.choice((1, 30, 600, 1799, 1800, 1801, 5000))
        out.append((who, at(t[who]), k, draw.choice(("user", None)), draw.choice(("hello there", "", None, "x" * 50))))
    return out


MESSAGE = "conv_id string, ts timestamp, turn long, role string, text string"


def test_sessions_are_those_of_a_loop(spark):
    rows = _messages(300, 3)
    want, last = {}, {}
    for who, when, turn, role, text in sorted(rows, key=lambda r: (r[1], r[2])):
        if who not in last or (when - last[who]).total_seconds() > 1800:
            want[(who, when)] = []
            start = when
        else:
            start = max(b for w, b in want if w == who)
        last[who] = when
        want[(who, start)].append((when, f"{role or 'unknown'}: {text or ''}"))
    want = {(w, b, x[-1][0], "\n".join(t for _, t in x), len(x)) for (w, b), x in want.items() if len("\n".join(t for _, t in x)) >= 100}
    given = spark.createDataFrame(rows + [("c", None, 999, "user", "no time")], MESSAGE)
    assert {tuple(r) for r in S.sessions(given).collect()} == want and len(want) > 5
    assert S.sessions(given.limit(0)).count() == 0


def test_streamed_sessions_are_saved_as_those_of_a_batch(spark, tmp_path):
    from quarry.api import Engine
    from quarry.sources.config import Settings

    rows = _messages(200, 8)
    given = spark.createDataFrame(rows + [("end", at(10_000_000), 1, "user", "z" * 120)], MESSAGE)
    given.write.parquet(str(tmp_path / "in" / "1"))
    stream = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in" / "*"))
    own = Engine.open(spark, Settings(auto_flush_on_compaction=True), f"file://{tmp_path}/ix")
    for _ in range(2):  # the second run has its number from the checkpoint, and nothing to add
        q = jobs.flush_sessions(own, stream, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    want = {r["text"].strip(" ") for r in S.sessions(spark.createDataFrame(rows, MESSAGE)).collect()}  # saves are kept without blanks around them
    kept = own.index.chunks.collect()
    assert {r["content"] for r in kept} == want and all(r["lookup_path"].startswith("session_log.") for r in kept) and len(want) > 2
    before = own.version
    own.flush_sessions(S.sessions(spark.createDataFrame(rows, MESSAGE)))  # flushed again: each replaces itself
    assert sorted(r["content"] for r in own.index.chunks.collect()) == sorted(r["content"] for r in kept)
    quiet = Engine.open(spark, Settings(), f"file://{tmp_path}/ix")
    assert quiet.flush_sessions(S.sessions(given)).version.number == before.number + 1


def test_ranges_by_line_places_are_those_of_the_whole_file(spark, tmp_path, monkeypatch):
    draw = random.Random(6)
    body = lambda n, end: end.join("x\u00e9" * draw.randrange(9) for _ in range(n))
    texts = {"a": body(900, "\n"), "b": body(700, "\r\n") + "\r\n", "c": "\ufeff" + body(600, "\n"), "d": "\ufeff" + body(600, "\n") + "\n", "e": "", "f": "\n", "g": "one", "h": "\n" * 700}
    read = []
    plain = S.read_bytes
    monkeypatch.setattr(S, "read_bytes", lambda spark, location, at, n: (read.append(n), plain(spark, location, at, n))[1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for name, text in texts.items():
            (tmp_path / name).write_bytes(text.encode())
            places = S.line_places(spark, f"file://{tmp_path}/{name}", 64).cache()
            lines = text.replace("\r\n", "\n").split("\n")
            for first, n in ((None, None), (1, 1), (64, 2), (65, 3), (200, 100), (599, 2), (600, 1), (601, 5), (10_000, 5), (-3, 0)):
                f = min(max(first or 1, 1), len(lines))
                m = min(max(20 if n is None else n, 1), len(lines) - f + 1)
                assert S.line_slice(spark, f"file://{tmp_path}/{name}", places, first, n) == (f, m, "\n".join(lines[f - 1 : f - 1 + m])), (name, first, n)
            places.unpersist()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = len(texts["a"].encode())
    read.clear()
    S.line_slice(spark, f"file://{tmp_path}/a", S.line_places(spark, f"file://{tmp_path}/a", 64), 400, 3)
    assert read[0] < whole / 5
