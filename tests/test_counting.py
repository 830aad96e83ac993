from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions.text import STOPWORDS
from quarry.operators import counting, index as I, segments as G
from tests.test_segments import WORDS, chunk_rows, content


def batches(rows, names, size):
    whole = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema(names.items()))
    return [whole.slice(k, size) for k in range(0, len(rows), size)]


def test_frequent_words_of_paths_that_go_over_batches():
    draw, names = random.Random(4), {"path": pa.string(), "words": pa.list_(pa.string())}
    rows = [(p, draw.choices(["the", "is", *WORDS, *"abc"], k=draw.randrange(12)) if draw.random() > 0.1 else None) for p in sorted(draw.choices("abcdefg", weights=[20, 1, 9, 1, 1, 7, 1], k=60))]
    want = {}
    for p, words in rows:
        want.setdefault(p, Counter()).update(w for w in words or () if len(w) >= 3 and w not in STOPWORDS)
    want = {(p, w, n) for p, c in want.items() for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:4]}
    for size in (1, 3, 7, 60):
        found = [tuple(r.values()) for b in counting.Frequent(4, 3, list(STOPWORDS))(iter(batches(rows, names, size))) for r in b.to_pylist()]
        assert set(found) == want and len(found) == len(want)


def test_blocks_of_zones_that_go_over_batches():
    draw, names = random.Random(6), {"zone": pa.int32(), "chunk_id": pa.int64(), "tokens": pa.list_(pa.string())}
    rows = sorted(((draw.randrange(4), k // 2 if k < 6 else k, draw.choices(WORDS, k=draw.randrange(9)) if k % 7 else None) for k in range(40)), key=lambda r: r[:2])
    for size in (1, 5, 40):
        each = {}
        for b in counting.blocks(iter(batches(rows, names, size))):
            for r in b.to_pylist():
                assert (r["term"], r["zone"]) not in each and r["n"] == len(r["chunk_ids"]) and r["most_tf"] == max(r["tfs"]) and r["least_dl"] == min(r["dls"])
                assert r["chunk_ids"] == sorted(r["chunk_ids"])
                each[r["term"], r["zone"]] = {c: (tf, at) for c, tf, at in zip(r["chunk_ids"], r["tfs"], r["positions"])}
        want = {}
        for zone, c, tokens in rows:
            for at, t in enumerate(tokens or ()):
                want.setdefault((t, zone), {}).setdefault(c, []).append(at)
        assert each == {k: {c: (len(a), sorted(a)) for c, a in v.items()} for k, v in want.items()}


def test_no_token_is_moved_by_itself_and_no_unwanted_block_taken_apart(spark, monkeypatch, capsys):
    draw = random.Random(2)
    chunks = chunk_rows(spark, [(i, f"a.b{i % 3}", i, content(draw), "f.md") for i in range(50)])
    tokens = I.cut(chunks.withColumn("tokens", I.fts_tokens("content")), "tokens")
    blocks = I.zoned(tokens, 50)
    blocks.explain()
    assert "Generate" not in capsys.readouterr().out
    rows = lambda df: sorted((r["term"], r["chunk_id"], r["tf"], r["dl"], *r["positions"]) for r in df.select("term", "chunk_id", "tf", "dl", "positions").collect())
    assert rows(I.unblocked(blocks)) == rows(I.postings(chunks))
    # more terms than a scan is told
    monkeypatch.setattr(I, "PUSHED_TERMS", 2)
    ix = I.Index(chunks, None, None, None, None, None, None, blocks=I.cut(blocks, "blocks"))
    wanted = spark.createDataFrame([("oak",), ("elm",), ("oak",), ("ash",), ("nowhere",)], "term string")
    assert {r["term"] for r in ix.of(wanted, ["term", "n"]).collect()} == {"oak", "elm", "ash"}
    # a row meets the set of terms before the scan's groups
    monkeypatch.setattr(I, "PUSHED_TERMS", 500)
    many = spark.createDataFrame([(f"w{k}",) for k in range(30)], "term string")
    ix.blocks.where(I._any_of(many)).explain()
    assert "INSET" in capsys.readouterr().out


def test_texts_of_words_give_the_blocks_of_their_lists(monkeypatch):
    draw = random.Random(9)
    rows = [(k // 9, k, [draw.choice(["é", "straße", "数", *WORDS]) for _ in range(draw.randrange(6))] if k % 5 else None) for k in range(60)]
    names = {"zone": pa.int32(), "chunk_id": pa.int64()}
    lists = [b.to_pylist() for b in counting.blocks(iter(batches(rows, names | {"tokens": pa.list_(pa.string())}, 60)))]
    texts = [(z, c, None if t is None else " ".join(t)) for z, c, t in rows]
    for size, run in ((60, 4 << 20), (7, 4 << 20), (7, 1), (1, 100)):
        monkeypatch.setattr(counting, "RUN_BYTES", run)
        found = [b.to_pylist() for b in counting.blocks(iter(batches(texts, names | {"tokens": pa.string()}, size)))]
        assert sorted(sum(found, []), key=lambda r: (r["term"], r["zone"])) == sum(lists, [])
        for each in found:  # a run is in order of terms and zones
            keys = [(r["term"].encode(), r["zone"]) for r in each]
            assert keys == sorted(keys)
        assert (len(found) == 1) == (run > 100)


def test_heaviest_terms_of_paths_that_go_over_batches():
    draw = random.Random(7)
    entry = pa.list_(pa.struct([("term", pa.string()), ("hundredths", pa.int32())]))
    names = {"path": pa.string(), "text": pa.string(), "named": entry, "told": entry}
    some = lambda n: [{"term": draw.choice([None, "zz", *WORDS[:5]]), "hundredths": draw.choice((50, 90, 110))} for _ in range(draw.randrange(n))]
    named = {p: some(4) for p in "abcdefg"}
    rows = []
    for p in sorted(draw.choices("abcdefg", weights=[20, 1, 9, 1, 1, 7, 1], k=50)):
        words = [w.lower() for w in draw.choices(["the", "is", "naïve", *WORDS, *"abc"], k=draw.randrange(14))]
        rows.append((p, draw.choice([" ", "-", ", ", "é"]).join(words) if draw.random() > 0.1 else None, named[p], some(5) if draw.random() > 0.1 else None))
    want = {}
    for path in {r[0] for r in rows}:
        counts, weight = Counter(), Counter()
        for _, text, _, told in (r for r in rows if r[0] == path):
            counts.update(w for w in re.findall("[a-z0-9]+", text or "") if len(w) >= 3 and w not in STOPWORDS)
            for x in told or ():
                weight[x["term"]] += x["hundredths"]
        for x in named[path]:
            weight[x["term"]] += x["hundredths"]
        for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:6]:
            weight[w] += min(65, 20 + 7 * n)
        weight.pop(None, None)
        want |= {(w, path): c / 100 for w, c in sorted(weight.items(), key=lambda x: (-x[1], x[0]))[:8]}
    for size in (1, 3, 7, 50):
        found = [tuple(r.values()) for b in counting.Weighed(6, 8, 3, list(STOPWORDS))(iter(batches(rows, names, size))) for r in b.to_pylist()]
        assert {r[:2]: r[2] for r in found} == want and len(found) == len(want)


ODD = ["", None, " ", "a", "Ab-1_c\n\n2", "É e\u0301cole \u212aelvin \u0130x", "\u0301", "x\u0301\u0302y z", "数字 ٣٤ ½ ²", "𝒳𝟗 😀a", "-- a", "ß ŉ ǅ", "a\x00b\u00a0c"]


def test_words_between_spaces_are_the_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "chunk_id long, content string")
    for r in I.with_words(rows).withColumn("want", I.fts_tokens("content")).collect():
        assert (r["tokens"].split(" ") if r["tokens"] else [] if r["tokens"] == "" else None) == r["want"]
        assert r["dl"] == (None if r["want"] is None else len(r["want"]))
    told = {r["term"]: r["n"] for r in I.chunks_per_term(I.with_words(rows)).collect()}
    assert told == Counter(t for r in rows.select(I.fts_tokens("content").alias("t")).collect() for t in set(r["t"] or ()))


def test_blocks_are_written_once_and_terms_moved_once(spark, tmp_path, capsys, monkeypatch):
    draw = random.Random(3)
    chunks = chunk_rows(spark, [(i, f"a.b{i % 3}", i, content(draw), "f.md") for i in range(40)])
    I.term_index(chunks).explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    ranged, frame = [], type(chunks)
    by_range = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: ranged.append(a) or by_range(self, *a))
    G.Store(spark, f"file://{tmp_path}/ix").change(None, chunks)
    assert all("term" not in a for a in ranged)


def test_every_character_is_told_as_by_the_patterns(spark):
    """All code points between letters, at the ends of texts and in rows of one class or mixed."""
    character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    points = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select("id", character.alias("c"))
    rows = points.groupBy((F.col("id") % 3_001).alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("id", "c"))).alias("x")).select("chunk_id", F.transform("x", lambda e: e["c"]).alias("x"))
    texts = rows.select("chunk_id", F.explode(F.array(F.array_join("x", ""), F.array_join("x", "b"), F.array_join("x", " "))).alias("content"))
    told = I.with_words(texts.repartition(4)).select("tokens", "dl", I.fts_tokens("content").alias("want"))
    assert told.where((F.col("tokens") != F.array_join("want", " ")) | (F.col("dl") != F.size("want"))).count() == 0


def test_texts_are_worked_on_in_slices(monkeypatch):
    """However many texts a batch has, only some of them are taken into words together."""
    monkeypatch.setattr(counting, "RUN_BYTES", 100)
    taken, whole = [], counting.words_of
    monkeypatch.setattr(counting, "words_of", lambda texts, inside: taken.append(sum(len(t or "") for t in texts.to_pylist())) or whole(texts, inside))
    draw, entry = random.Random(5), pa.list_(pa.struct([("term", pa.string()), ("hundredths", pa.int32())]))
    rows = [(f"p{k // 3:02d}", " ".join(draw.choices(WORDS, k=5)) if k % 8 else None, [], []) for k in range(60)]
    names = {"path": pa.string(), "text": pa.string(), "named": entry, "told": entry}
    found = [r["lookup_path"] for b in counting.Weighed(9, 9, 3, [])(iter(batches(rows, names, 60))) for r in b.to_pylist()]
    assert len(set(found)) == 20 and max(taken) < 200
    taken.clear()
    texts = [(t,) for _, t, *_ in rows]
    n = Counter()
    for b in counting.chunks_per_word(iter(batches(texts, {"tokens": pa.string()}, 60))):
        n.update({r["term"]: r["n"] for r in b.to_pylist()})
    assert n == Counter(w for (t,) in texts for w in set((t or "").split())) and max(taken) < 200


def test_chunks_are_written_once_and_their_tokens_never(spark, tmp_path, monkeypatch):
    draw, cuts = random.Random(8), []
    chunks = chunk_rows(spark, [(i, f"a.b{i % 3}", i, content(draw), "f.md") for i in range(20)])
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda df, name: cuts.append((name, df.columns)) or cut(df, name))
    store = G.Store(spark, f"file://{tmp_path}/ix")
    version = store.change(None, chunks)
    assert not [name for name, columns in cuts if "content" in columns or "tokens" in columns]
    have = store.table(version, "chunks").select("chunk_id", "dl", F.size(I.fts_tokens("content")).alias("n")).collect()
    assert len(have) == 20 and all(r["dl"] == r["n"] for r in have)
