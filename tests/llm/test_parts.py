"""Parts of the operators by themselves: exactness, stitching, other ways for very large groups."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import public_tokenizers
from quarry.llm import alignment, backtrack, bpe, fingerprints, jaccard, lexicon, licenses, manifest, packing, pii, quality, session, substrings, textnp, toxicity
from quarry.llm.weak import Voters, fit


def test_chunks_are_stitched_where_cuts_meet():
    pattern, draw = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    for _ in range(2000):
        s = "".join(draw.choice("ab 1\n\t!'sé  ") for _ in range(draw.randrange(200)))
        assert bpe.stitched(pattern, bpe.chunked(s, 20, 8), 8) == pattern.findall(s)


@pytest.mark.parametrize("size, overlap", [(64, 16), (300, 40), (5, 2)])
def test_chunks_of_long_texts_are_dealt_out(spark, rows, size, overlap):
    """Also where an overlap has no common cut (a run of letters longer than it)."""
    import public_tokenizers as P

    codec = bpe.codec(bpe.tables(), P.PATTERN).codec
    texts = [(i, t) for i, t, *_ in rows if i is not None and len(t or "") < 3000][-40:] + [(1, "x" * 500), (2, "a  \n\n  b " * 60), (2, "a  \n\n  b " * 60)]
    got = bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), size=size, overlap=overlap).collect()
    want = [(i, codec.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts]
    assert sorted((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got) == sorted(want)


def test_pretokens_are_those_of_the_pattern():
    pattern, draw = regex.compile(public_tokenizers.PATTERN), random.Random(2)
    for _ in range(3000):
        s = "".join(draw.choice("ab 1\n\t!'sretvmld é'  ") for _ in range(draw.randrange(1, 60)))
        points = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        first[0] = True
        at = packing.pretokens(points, first).tolist()
        assert [s[a:b] for a, b in zip(at, [*at[1:], len(s)])] == pattern.findall(s)


def test_suffix_sort_and_repeated_windows():
    draw = np.random.default_rng(3)
    data = draw.integers(0, 3, 4000).astype(np.uint8)
    data[2500:2900] = data[100:500]
    at, group = np.arange(len(data) - 40), np.zeros(len(data) - 40, np.int64)
    order = substrings.suffix_sort(data, textnp.prefix_hashes(data), at, group, 40)
    keys = [bytes(data[p : p + 40]) for p in order]
    assert keys == sorted(keys)
    found = substrings.repeated_windows(data, at, group, 40)
    windows = [bytes(data[p : p + 40]) for p in at]
    assert found.tolist() == [windows.count(w) > 1 for w in windows]
    halves = at % 2  # windows equal across groups don't count
    found = substrings.repeated_windows(data, at, halves, 40)
    assert found.tolist() == [sum(v == w for v, h in zip(windows, halves) if h == g) > 1 for w, g in zip(windows, halves)]


def _spans(spark, texts: list[str], **more) -> list:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r["id"], [tuple(x) for x in r["spans"]]) for r in substrings.repeats(docs, **more).collect())


def _passages(n: int = 6) -> list[str]:
    """A passage in various contexts, and a whole copy."""
    draw = random.Random(4)
    text = lambda k: "".join(draw.choice("abcdefghij ") for _ in range(k))
    passage = text(320)
    out = [text(300) + passage[k : 320 - k] + text(250) for k in range(n)]
    return [*out, out[0]]


def test_collisions_of_hashes_remove_nothing_else(spark, monkeypatch):
    """Everything that is hashed by `textnp` collides; only bytes tell texts apart, from the first count to the last span."""
    texts = _passages()
    want = _spans(spark, texts)
    monkeypatch.setattr(textnp, "mix", lambda h: np.zeros_like(h))
    monkeypatch.setattr(substrings, "MOST_KINDS", 10**9)
    assert _spans(spark, texts) == want
    # hashes that say of all suffixes that they agree: neighbours' bytes differ, so nothing goes that isn't a whole kind
    at = np.arange(300)
    data = np.random.default_rng(4).integers(0, 255, 500).astype(np.uint8)
    monkeypatch.setattr(substrings, "common", lambda prefix, p, q, most: np.full(len(p), most))
    assert not substrings.repeated_windows(data, at, np.zeros(300, np.int64), 100).any()


def test_the_sorted_order_finds_the_repeats(spark, monkeypatch):
    texts = _passages()
    draw = random.Random(5)
    texts = ["".join(draw.choice("abcdefghij ") for _ in range(150)) + texts[k % 3][300:560] for k in range(40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([np.arange(k * 410, k * 410 + 211) for k in range(40)])
    group = np.zeros(len(at), np.int64)
    windows = [bytes(data[p : p + 200]) for p in at]
    want = [windows.count(w) > 1 for w in windows]
    assert substrings.repeated_windows(data, at, group, 200).tolist() == want
    monkeypatch.setattr(substrings, "suffix_sort", lambda data, prefix, at, group, most: np.arange(len(at)))
    assert substrings.repeated_windows(data, at, group, 200).tolist() != want


def test_many_kinds_are_grouped_by_bytes(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    got = [{(r["id"], str(r["spans"])) for r in substrings.repeats(docs, most_kinds=k).collect()} for k in (20_000, 1)]
    assert got[0] == got[1] and got[0]


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 200, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = None
    for size in (512, 8):
        monkeypatch.setattr(jaccard, "BLOCK_TEXTS", size)
        members, found = jaccard.classes(docs)
        got = sorted((r["id"], r["class_id"], r["links"]) for r in members.join(found, "node").collect())
        want = want or got
        assert got == want
    assert {x[1] for x in got} == {0} and all(x[2] == 49 for x in got)


def test_prefixes_are_shortened_to_the_recall():
    met = np.zeros(jaccard.SKETCH + 1, np.int64)
    met[-1] = 10**6  # all links met are between texts that are nearly equal
    high = jaccard.prefix_length(met, 0.8)
    met[int(jaccard.SKETCH * 0.82)] = 10**6
    low = jaccard.prefix_length(met, 0.8)
    assert low < high <= jaccard.DEPTH
    for d in (low, low + 1):  # links of a similarity of 0.82 are what is missed
        missed = (1 - 0.82**d) ** jaccard.TREES
        assert (missed < 2 * (1 - jaccard.RECALL)) == (d == low)
    assert jaccard.prefix_length(met, 0.8, recall=0.9) == jaccard.DEPTH


@pytest.mark.parametrize("most", [4096, 4])
def test_texts_that_share_boilerplate_are_not_grouped(spark, monkeypatch, most):
    """Texts of Jaccard 0.37 without a link: no group and no link, also where nodes are dealt out as pairs of blocks; near copies among them are found."""
    monkeypatch.setattr(jaccard, "NODE_ROWS", most)
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    boilerplate = [word() for _ in range(120)]
    texts = [" ".join(boilerplate + [word() for _ in range(100)]) for _ in range(600)]
    texts += [t + " " + word() for t in texts[:5]]
    rows = spark.createDataFrame([(k, None, t) for k, t in enumerate(texts)], "id long, node binary, text string").withColumn("node", F.unhex(F.md5("text")))
    groups, _ = jaccard.candidates(jaccard.signatures(rows))
    assert sorted(r["count"] for r in groups.groupBy("root").count().collect()) == [2] * 5
    members, found = jaccard.classes(rows.select(F.col("id").alias("doc_id"), "text"))
    got = {r["id"]: (r["class_id"], r["links"]) for r in members.join(found, "node").collect()}
    n = len(texts) - 5
    assert all(got[k] == (k - n if k >= n else k, int(k < 5 or k >= n)) for k in range(len(texts)))


@pytest.mark.parametrize("similarity", [0.81, 0.9])
def test_forest_lets_links_meet(spark, similarity):
    """Of pairs just above the threshold, and of pairs well above it, all meet."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(300):
        words = [word() for _ in range(204)]  # 200 shingles, of which the first few differ
        n = round(200 * (1 - similarity) / (1 + similarity))
        texts += [" ".join(words), " ".join([word() for _ in range(n)] + words[n:])]
    members, found = jaccard.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["id"]: (r["class_id"], r["links"]) for r in members.join(found, "node").collect()}
    assert all(got[k] == (k // 2 * 2, 1) for k in range(600))


def _toxicity_by_hand(texts: list[str], examples: dict[str, list[tuple[int, int]]]) -> dict[str, float]:
    """Scores by plain cosines of whole texts, in dictionaries. examples: of each text its (id, label)."""
    import math
    from collections import Counter

    find = lambda t: regex.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))
    known = sorted({w for t in {*texts, *examples} for w in find(t)})
    cell = dict(zip(known, lexicon.cells(pa.array(known, pa.string()))[0].tolist()))  # words of one cell are one
    words = {t: Counter(cell[w] for w in find(t)) for t in {*texts, *examples}}
    df = Counter(w for t in texts for w in words[t])
    rate = {t: sum(y for _, y in of) / len(of) for t, of in examples.items()}
    yes, no = Counter(), Counter()
    for t, r in rate.items():
        for w in words[t]:
            yes[w], no[w] = yes[w] + r, no[w] + 1 - r
    scale = {w: math.log((len(texts) + 1) / n) * math.log2(2 + yes[w] / max(no[w], 1)) ** 2 for w, n in df.items()}
    vector = {}
    for t, c in words.items():
        v = {w: (1 + math.log(n)) * scale[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vector[t] = {w: x / norm for w, x in v.items()} if v else {}
    share = sum(y for of in examples.values() for _, y in of) / sum(map(len, examples.values()))
    out = {}
    for t in words:
        if not vector[t]:
            of = [y for e, of in examples.items() if not vector[e] for _, y in of]
            out[t] = (sum(of) + toxicity.PRIOR * share) / (len(of) + toxicity.PRIOR)
            continue
        near = sorted(((sum(x * vector[e].get(w, 0) for w, x in vector[t].items()), len(of), rate[e]) for e, of in examples.items()), reverse=True)
        near, n, votes, total, last = [x for x in near if x[0] > 1e-12], 0, toxicity.PRIOR * share, toxicity.PRIOR, 0
        for s, size, r in near:
            if n >= toxicity.NEIGHBOURS and s < last - 1e-9:
                break
            n, votes, total, last = n + size, votes + s * size * r, total + s * size, s
        out[t] = votes / total if near else share
    return out


def test_toxicity_is_that_of_whole_texts_cosines(spark, sf):
    """Every score of the small documents against plain cosines; small blocks, so that bounds have to skip some."""
    import zlib

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect():
        labels[r["doc_id"]] = max(r["toxic"], labels.get(r["doc_id"], 0))
    examples: dict[str, list] = {}
    for i, t in docs:
        if i in labels and zlib.crc32(str(i).encode()) % 4 != 2:
            examples.setdefault(t or "", []).append((i, labels[i]))
    examples = {t: [(min(i for i, _ in of), max(y for _, y in of))] for t, of in examples.items()}  # a text counts once
    want = _toxicity_by_hand([t or "" for _, t in docs], examples)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for of in examples.values() for i, y in of], "doc_id long, toxic int")
    index = toxicity.learn(frame, known)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, index, ["doc_id"]).collect()}
    assert max(abs(got[i] - want[t or ""]) for i, t in docs) < 1e-4


def test_toxicity_of_held_out_rows(spark):
    """Learned on one fold, told on the other: a few words decide, whatever the rest of the text."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 6)))
    common = [word() for _ in range(60)]
    bad = ["vile", "scum", "awful", "trash", "loser", "rotten"]
    rows = []
    for k in range(600):
        text = [draw.choice(common) if draw.random() < 0.5 else word() for _ in range(100)]
        toxic = k % 5 == 0
        for _ in range(4 if toxic else 0):
            text.insert(draw.randrange(len(text)), draw.choice(bad))
        rows.append((k, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    index = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows if i % 4 != 2], "doc_id long, toxic int"))
    held = {r["doc_id"]: r["score"] >= toxicity.TOXIC for r in toxicity.score(docs, index, ["doc_id"]).collect() if r["doc_id"] % 4 == 2}
    right = [held[i] == bool(y) for i, _, y in rows if i in held]
    assert sum(right) >= 0.97 * len(right)


def test_sketches_merge_and_contain():
    words = [f"w{k}" for k in range(4000)]
    whole, part, other = fingerprints.sketches(pa.array([" ".join(words), " ".join(words[:400]), " ".join(reversed(words))]))
    assert fingerprints.likeness(part, whole) > 0.95 and fingerprints.likeness(other, whole) == 0
    assert np.array_equal(fingerprints.merge(part, whole), whole) or len(np.setdiff1d(part, whole)) <= 1
    assert 0.8 < len(whole) / (4000 * fingerprints.FRACTION) < 1.2


def test_blocks_of_a_node_hold_all_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "NODE_ROWS", 10)
    rows = [(1, bytes([k]), bytes([k]), b"", 37) for k in range(37)] + [(2, bytes([k]), bytes([k]), b"", 10) for k in range(10)]
    members = spark.createDataFrame(rows, "key long, node binary, label binary, sketch binary, n long")
    held: dict[int, set] = {}
    for r in jaccard._blocks(members).collect():
        held.setdefault(r["block"], set()).add(r["label"][0])
    together = {(a, b) for names in held.values() for a in names for b in names}
    assert together == {(a, b) for a in range(37) for b in range(37)} and held[2] == set(range(10))
    assert max(len(x) for x in held.values()) <= 20


def _spans_by_hand(candidates: list[dict]) -> list[bool]:
    """Plain expectation-maximisation over votes, then naive Bayes over votes and features."""
    import math

    start, rules = pii.START, list(pii.START.accuracy)
    prior, right = start.prior, dict(start.accuracy)
    told = lambda c: 1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(c[r] * math.log(right[r] / (1 - right[r])) for r in rules)))
    some = [c for c in candidates if any(c[r] for r in rules)]
    for _ in range(60):
        p = [told(c) for c in some]
        was = [prior, *right.values()]
        prior = min(max((sum(p) + 20 * start.prior) / (len(p) + 20), 0.02), 0.98)
        for r, a in start.accuracy.items():
            votes = [(c[r], x) for x, c in zip(p, some) if c[r]]
            right[r] = min(max((sum(x if v > 0 else 1 - x for v, x in votes) + 20 * a) / (len(votes) + 20), 0.5), 0.98)
        if max(abs(a - b) for a, b in zip(was, [prior, *right.values()])) < 1e-3:
            break
    p = [told(c) for c in candidates]
    values = {f: {c[f] for c in candidates} for f in pii.FEATURES}
    yes, no = sum(p), len(p) - sum(p)
    weigh = lambda f, v, q, all_: (sum(x for x, c in zip(q, candidates) if c[f] == v) + 2) / (all_ + 2 * len(values[f]))
    rest = [1 - x for x in p]
    odds = {(f, v): math.log(weigh(f, v, p, yes) / weigh(f, v, rest, no)) for f in pii.FEATURES for v in values[f]}
    return [math.log((yes + 2) / (no + 2)) + sum(odds[f, c[f]] for f in pii.FEATURES) >= 0 for c in candidates]


def test_spans_are_told_from_hard_negatives(spark):
    """Secrets, accounts and names of people stay spans; parts of paths (though a labeler takes them for secrets) and numbers of runs don't. The decisions are those of the plain version."""
    draw = random.Random(14)
    hexa = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    good = [f'{draw.choice(["token", "secret", "api_key", "password"])} = "{hexa(40)}" is set' for _ in range(60)]
    good += [f"IBAN: DE{draw.randrange(10, 99)}{draw.randrange(10**17, 10**18)} of ours" for _ in range(40)]
    good += [f"My name is {draw.choice(['Anna', 'Peter', 'Maria'])} {draw.choice(['Kovan', 'Lindor'])} and so on" for _ in range(40)]
    bad = [f"in C:\\{word()}_{word()}_{word()}{draw.randrange(10)}\\bin is it" for _ in range(120)]
    bad += [f"run {draw.randrange(10**7, 10**8)}_{draw.randrange(10**5, 10**6)}_{draw.randrange(10**8, 10**9)} of today" for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    found = pii.cut(pii.found_spans(docs), "found")
    model = pii.learn(found)
    rows = found.select(F.col("row.doc_id").alias("doc_id"), F.explode("__loose").alias("c")).select("doc_id", "c.*", (model.log_odds(F.col("c")) >= 0).alias("yes")).orderBy("doc_id", "start").collect()
    assert [r["yes"] for r in rows] == _spans_by_hand([r.asDict() for r in rows])
    assert {r["kind"] for r in rows if r["yes"]} == {"secret", "account", "name"}
    assert {r["doc_id"] for r in rows if r["yes"]} == set(range(len(good)))
    assert {r["doc_id"] for r in rows if not r["yes"]} >= set(range(len(good), len(good + bad)))


def test_votes_find_the_accurate_rule(spark):
    """Accuracies and the prior come from the votes, wherever they start; rows without votes change nothing."""
    draw = np.random.default_rng(6)
    truth = draw.random(4000) < 0.2
    vote = lambda a: np.where(draw.random(4000) < a, truth, ~truth) * 2 - 1
    rows = [tuple(int(x) for x in r) for r in zip(vote(0.95), vote(0.75), vote(0.75))]
    start = Voters(0.5, {"a": 0.8, "b": 0.8, "c": 0.8})
    found = fit(spark.createDataFrame(rows, "a int, b int, c int"), start)
    assert found.accuracy["a"] > 0.9 and abs(found.accuracy["b"] - 0.75) < 0.05 and abs(found.prior - 0.2) < 0.04
    assert fit(spark.createDataFrame(rows + [(0, 0, 0)] * 500, "a int, b int, c int"), start) == found


def test_redaction(spark):
    text = "Mail a.b@c.de or call +49 (30) 1234-567 now."
    docs = spark.createDataFrame([(1, text, 44), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(docs).collect()}
    assert got == {1: ("Mail [EMAIL] or call [PHONE] now.", 33), 2: (None, None), 3: ("clean", 5)}


def _names() -> list[str]:
    return [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re") for b in ("lan", "dor", "vin", "sat", "pel", "gom")]


def _texts(draw: random.Random, n: int, end: str = "", stop: str = ".") -> list[str]:
    names = _names()
    return [" ".join((draw.choice(names).capitalize() if k % 9 == 0 else draw.choice(names)) + end + (stop if k % 9 == 8 else "") for k in range(120)) for _ in range(n)]


def test_bad_kinds_are_rejected_and_clean_texts_stay(spark):
    draw = random.Random(7)
    clean, symbols = _texts(draw, 160), _texts(draw, 8, end="###") + _texts(draw, 8, end="|")
    docs = spark.createDataFrame(list(enumerate(clean + symbols)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "q", "__w", "kept", "markup", "quality")})
    kept = quality.keep_good(docs)
    assert {r["doc_id"] for r in kept.collect()} == set(range(160)) and kept.columns == docs.columns


def test_estimation_overturns_a_wrong_start(spark):
    """Sentences without full stops are usual here, though the rule starts as one that goes with bad texts: none goes for it, what is bad otherwise does."""
    draw = random.Random(8)
    clean = _texts(draw, 150) + _texts(draw, 150, stop="")
    bad = _texts(draw, 60, end="###") + _texts(draw, 30, end="|")
    docs = spark.createDataFrame(list(enumerate(clean + bad)), "doc_id long, text string")
    measured = quality.cut(quality.measures(docs), "measured")
    rates = quality.learn(measured)
    ratio = lambda r, vote: r[0][vote] / r[1][vote]
    assert ratio(quality.START.rates["sentences"], 0) < 0.1 < 0.4 < ratio(rates.rates["sentences"], 0)
    assert ratio(rates.rates["markup"], 0) < ratio(quality.START.rates["markup"], 0) / 3
    kept = lambda r: {x["row"]["doc_id"] for x in quality.score(measured, r).where("kept").collect()}
    assert kept(rates) == set(range(300)) != kept(quality.START)


def test_rates_are_those_of_plain_expectation_maximisation(spark):
    draw = np.random.default_rng(9)
    rules = quality.RULES
    rows = draw.choice([-1, 0, 1], size=(500, len(rules)), p=(0.1, 0.2, 0.7))
    rows[:60, :3] = -1
    got = quality.fit_rates(spark.createDataFrame([tuple(map(int, r)) for r in rows], ", ".join(f"{r} int" for r in rules)), quality.START)
    start = np.array([quality.START.rates[r] for r in rules])
    rates, prior = start.copy(), quality.START.prior
    for _ in range(60):
        odds = np.log(prior / (1 - prior)) + sum(np.log(rates[k, 0, rows[:, k] + 1] / rates[k, 1, rows[:, k] + 1]) for k in range(len(rules)))
        p, was = 1 / (1 + np.exp(-odds)), rates.copy()
        for c, w in enumerate((p, 1 - p)):
            for v in range(3):
                rates[:, c, v] = ((w[:, None] * (rows == v - 1)).sum(0) + 20 * start[:, c, v]) / (w.sum() + 20)
        prior = (p.sum() + 20 * quality.START.prior) / (len(rows) + 20)
        if abs(rates - was).max() < 1e-3:
            break
    assert np.allclose([got.rates[r] for r in rules], rates, atol=1e-6) and abs(got.prior - prior) < 1e-6


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6])
def test_shingles_of_short_texts(n):
    h, row = textnp.word_shingles(pa.array([" ".join("abcdef"[:n]), None, ""]))
    assert row.tolist() == [0] * max(1, n - 4)


def test_packing_weighs_words_of_most_documents():
    """Copies that hold over half of a shard find each other."""
    words = np.array([3, 5, 7])
    df = np.zeros(1 << lexicon.BUCKETS, np.int64)
    df[[3, 5, 7, 9]] = 4, 4, 4, 1
    shard = packing.Shard([words, np.array([9]), words, words, words], lexicon.Statistics(5, 2.6, df))
    shard.unused[0] = False
    assert shard.neighbours(0).tolist() == [2, 3, 4]


def test_packing_deals_likes_together_in_any_layout(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(20)) for _ in range(1500)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(k + 1500, f"{t} {k}") for k, t in enumerate(texts)]
    shuffled = docs[:]
    draw.shuffle(shuffled)
    found = []
    for rows, n in ((docs, 3), (shuffled, 7)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        found.append(sorted((r["id"], r["start"], r["sequence_id"], r["offset"]) for r in packing.pack(df).collect()))
    assert found[0] == found[1]
    group = {r[0]: r[2] >> 32 for r in found[0]}
    assert len(set(group.values())) > 1
    assert sum(group[k] == group[k + 1500] for k in range(1500)) > 1450
    window = {r[0]: r[2] for r in found[0]}
    assert sum(window[k] == window[k + 1500] for k in range(1500)) > 1350  # row order puts none together


def test_sketches_of_short_texts_are_compared_below_both_limits():
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    for k in (5, 6, 9, 14, 24, 60, 300):
        for _ in range(20):
            a, b = ([word() for _ in range(k)] for _ in range(2))
            x, y, both = fingerprints.sketches(pa.array([" ".join(a), " ".join([*a, *b]), " ".join(b)]))
            sets = [np.unique(textnp.word_shingles(pa.array([" ".join(t)]))[0]) for t in (a, b)]
            assert np.array_equal(fingerprints.merge(x, both), fingerprints.merge(both, x))
            union = np.union1d(*sets)
            assert np.array_equal(fingerprints.merge(x, both), fingerprints.below(union, fingerprints.limit(union)))
            if k <= 60:
                assert fingerprints.likeness(x, y) == 1  # contained; the longer text has at most 128 shingles
    edited = fingerprints.sketches(pa.array(["a b c d e f g h i j k l", "a b c d e f g h i x y z"]))
    assert fingerprints.likeness(*edited) == 5 / 8


def test_long_and_dotted_secrets_are_whole(spark):
    draw = random.Random(10)
    key = lambda n: "".join(draw.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMN0123456789") for _ in range(n))
    signed = f"eyJ{key(17)}.eyJ{key(60)}.{key(43)}"
    long, plain = key(2000), key(40)
    text = f'token = "{signed}" and secret = "{long}" and token {signed}. Then key = {plain}.'
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.found_spans(docs).first()["__loose"]
    assert [text[c["start"] : c["end"]] for c in found if c["kind"] == "secret"] == [signed, long, signed, plain]
    redacted = pii.redact(docs).first()["text"]
    assert signed not in redacted and signed.split(".")[1] not in redacted


@pytest.mark.parametrize("text, label", [
    ("Unauthorized copying of this file", "proprietary"), ("released into the public\ndomain", "public-domain"), ("Public-Domain dedication", "public-domain"),
    ("to the placed in the public  domain", "public-domain"), ("SPDX-License-Identifier: MS-PL", "ms-pl"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("SPDX-License-Identifier: Zlib", "zlib"), ("SPDX-License-Identifier: MS-RL", "ms-rl"),
])
def test_no_gate_hides_a_rule(spark, text, label):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert label in [d["label"] for d in licenses.scan(docs).first()["detections"]]


def test_collisions_of_pretokens_are_told_apart(monkeypatch):
    own = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = ["The quick brown fox", "jumps over the lazy dog, the dog!", ""]
    want = [own.whole(t).tolist() for t in texts]
    for mixed in (textnp.mix, lambda h: h & np.uint64(1)):
        monkeypatch.setattr(textnp, "mix", mixed)
        ids, ends, _, _ = own.encode(texts)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_license_detections_are_those_of_a_plain_scan(spark, rows):
    """All rules without a gate on every text, suppressed pair by pair, words counted one by one."""
    notices = [n[0].replace("[sc]", "s").replace("(?:", "").replace(")?", "").replace(")", "") for n in licenses.NOTICES]
    draw = random.Random(13)
    texts = [t or "" for _, t, *_ in rows][-60:] + [" ".join(draw.choice(notices) for _ in range(6)) for _ in range(40)] + ["CC BY 4.0, cc by. " * 50, "All rights reserved under the MIT license\n" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: sorted((d["word"], d["n_words"], d["label"], d["rule"]) for d in r["detections"]) for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        normal = " ".join(words).encode()
        every = [(m.start(), m.end(), k, r) for k, r in enumerate(licenses.rules()) for m in r.pattern.finditer(normal)]
        rank = lambda d: (d[3].priority, d[0] - d[1], d[2], d[0])
        kept: list = []
        for d in sorted(every, key=rank):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        assert got[i] == sorted((normal[:s].count(b" "), normal[s:e].count(b" ") + 1, r.label, r.name) for s, e, _, r in kept)
    assert len(licenses.NOTICES) + len(licenses.IDENTIFIERS) > 200


def test_long_license_texts_take_linear_time():
    import time

    text = b"all rights reserved copyright 2020 x cc by 4 0 " * 40_000
    began = time.process_time()
    assert len(licenses.base_places(text)) == 40_000 and len(licenses.detect(text)) >= 120_000
    assert time.process_time() - began < 60


def test_spans_of_long_texts(spark):
    """Thousands of matches, places and rewritten text against a plain scan."""
    draw = random.Random(14)
    parts = [draw.choice(["Mail a{}@b.de and ", "at 10.0.{}.1 or ", "é{} 😀 ", "Contact John Smith "]).replace("{}", str(draw.randrange(200))) for _ in range(8000)]
    text = "".join(parts)
    docs = spark.createDataFrame([(1, text, "x"), (2, None, None)], "doc_id long, text string, __base string")
    found = next(r for r in pii.found_spans(docs).collect() if r["row"]["doc_id"] == 1)
    for kind, pattern in (("email", pii.EMAIL), ("ip", pii.IP)):
        assert [(x["start"], x["end"]) for x in found["__base"][kind]] == [(m.start(), m.end()) for m in regex.finditer(pattern, text)]
    done = pii.redact(docs)
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    want = regex.sub(pii.IP, "[IP]", regex.sub(pii.EMAIL, "[EMAIL]", text))
    assert got[1].replace("[NAME]", "John Smith") == want and got[2] is None
    assert done.columns == docs.columns


def plain_merges(merges, text):
    """The merges one by one: the least number first, of equal ones the one further left."""
    parts = list(text)
    while True:
        found = [(merges[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not found:
            return parts
        _, k = min(found)
        parts[k : k + 2] = ["".join(parts[k : k + 2])]


@pytest.mark.parametrize("seed", range(12))
def test_backtracking_gives_the_merges(seed):
    """Small vocabularies of few letters, in which merges of equal letters, overlaps and dead ends are frequent."""
    draw = random.Random(seed)
    tokens, merges = list("abc"), {}
    while len(merges) < draw.choice((5, 12, 30)):
        pair = draw.choice(tokens), draw.choice(tokens)
        # a merge has to be met: the merges so far keep its two parts apart and whole
        if "".join(pair) not in tokens and plain_merges(merges, "".join(pair)) == list(pair):
            merges[pair] = len(merges)
            tokens.append("".join(pair))
    letters = {b: c for c, b in backtrack.byte_letters().items()}
    every = [letters[b] for b in range(256)] + ["".join(p) for p in merges]
    own = backtrack.Merges({t: i for i, t in enumerate(every)}, list(merges), {})
    for _ in range(400):
        text = "".join(draw.choice("aab" if draw.random() < 0.5 else "abc") for _ in range(draw.randrange(40)))
        assert [every[i] for i in own.encode(text)] == plain_merges(merges, text)


def test_backtracking_takes_linear_time_and_added_tokens():
    import time

    from tokenizers import Tokenizer

    own = backtrack.backtracker(backtrack.tables(), public_tokenizers.PATTERN)
    reader = Tokenizer.from_file(backtrack.tables())
    for t in ("<|endoftext|>", "a  <|endoftext|>b<|endoftext|>", "!<|endoftext|<|endoftext|>", " <|endoftext|> x's"):
        ids = own.encode([t])
        assert ids.tolist() == reader.encode(t, add_special_tokens=False).ids and own.decode(ids) == t.encode()
    assert own.decode(np.array([own.encode(["é"])[0]], "<u4")) == "é".encode() and own.decode(np.zeros(0, "<u4")) == b""
    began = time.time()
    own.merges.encode("e" * 300_000)
    assert time.time() - began < 20


def test_added_tokens_on_chunk_ends(spark):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(backtrack.tables())
    texts = [(k, "x" * k + " <|endoftext|> and <|endoftext|>!<|endoftext|" * 12) for k in range(40)] + [(99, None), (100, "")]
    got = backtrack.encode(spark.createDataFrame(texts, "doc_id long, text string"), size=64, overlap=40).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == [(k, reader.encode(t or "", add_special_tokens=False).ids) for k, t in texts]


def test_windows_are_cut_at_verified_anchors_only():
    own = alignment.aligner(bpe.tables(), public_tokenizers.PATTERN, bpe.tables("piece_bpe_32k.model"))
    draw = random.Random(4)
    for _ in range(300):
        text = "".join(draw.choice(["a", "the", " ", "  ", "\n", "é", "日", "😀", "'s", "ing", "<s>", "<0x41>", "zz"]) for _ in range(draw.randrange(1, 60)))
        n_a, n_b, groups, links = own.align(text)
        told = " " + text
        if not n_a:
            continue
        a, b = own.a.encode([told]).astype(np.int32), own.b.encode(told)
        assert b.tolist() == own.b.model.encode(text)
        whole, pairs = own.aligned(a.tolist(), b.tolist())
        assert whole == groups and pairs == links.tobytes() and (n_a, n_b) == (len(a), len(b))
    assert own.align("a\u2581b")[0] == 0 and own.align("")[0] == own.align(None)[0] == 0


def test_windows_are_aligned_by_column(monkeypatch):
    """No window is walked token by token, and groups inside windows are found all the same."""
    own = alignment.Aligner(bpe.tables(), public_tokenizers.PATTERN, bpe.tables("piece_bpe_32k.model"))
    texts = ["Unbelievably long interdisciplinary words, and (nested) ones.", "a", " ", "12345678901234567890 x'y\n\n\tz", "日本語 😀😀 é" * 20]
    want = []
    for text in texts:
        a, b = own.a.encode([" " + text]).astype(np.int32), own.b.encode(" " + text)
        want.append(own.aligned(a.tolist(), b.tolist()))
    assert any(b"," in told for told, _ in want) and any(told.count(b";") > 20 for told, _ in want)
    monkeypatch.delattr(alignment.Aligner, "aligned")
    got = [own.align(text) for text in texts]
    assert [(told, links.tobytes()) for _, _, told, links in got] == want


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 17, 31, 32, 33, 70])
def test_witnesses_grow_with_the_tree(spark, n):
    """Blocks of four leaves, so that there are several rounds of roots."""
    leaves = [manifest.digest(str(k)) for k in range(n)]
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([manifest.digest(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    rows = spark.createDataFrame([(g, k, n, x) for g in ("a", "b") for k, x in enumerate(leaves)], "group string, pos long, n long, digest string")
    got = manifest.trees(rows, levels=2).withColumn("k", F.col("pos")).collect()
    assert len(got) == 2 * n
    for r in got:
        want, k = [], r["pos"]
        for nodes in levels[:-1]:
            want.append((k % 2 == 1 and True, nodes[k ^ 1] if k ^ 1 < len(nodes) else None))
            k //= 2
        assert [(s["left"] if s["digest"] else False, s["digest"]) for s in r["siblings"]] == [(left if d else False, d) for left, d in want] and r["root"] == levels[-1][0]


def test_topics_are_counted_over_all_rows(spark, monkeypatch):
    """The groups of a topic are as many as all of its rows ask for; none is told by some of them."""
    monkeypatch.setattr(packing, "SIZING_ROWS", 64, raising=False)
    monkeypatch.setattr(packing, "SHARD_DOCS", 4)
    texts = [(k, f"{'alpha' if k < 100 else 'beta'} own{k} own{k} pair{k // 2}") for k in range(300)]
    rows = spark.createDataFrame(texts, "id long, text string")
    got = packing.dealt(rows, packing.statistics(rows)).select("group", "id").collect()
    assert len(got) == 300
    alpha, beta = ({r["group"] for r in got if (r["id"] < 100) == first} for first in (True, False))
    n = {"alpha": -(-4 * 100 // 12), "beta": -(-4 * 200 // 12)}
    first = min(alpha) < min(beta)
    low, high, size = (alpha, beta, n["alpha"]) if first else (beta, alpha, n["beta"])
    assert 1 <= min(low) and max(low) <= size < min(high) and max(high) <= sum(n.values())
    assert min(high) - size <= 5 and size - max(low) <= 5


def test_workers_give_memory_back(spark, monkeypatch):
    """Of what a task took, little is held once it has ended; packing sends its statistics to the workers once."""
    held = lambda: sum(int(x) for x in re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())) / 1024  # noqa: E731, SIM115

    def run(batches):
        for n in batches:
            kept = [pa.array(np.arange(1000 * n)).cast(pa.string()) for _ in range(200)]
            yield sum(map(len, kept))

    session.release()
    before = held()
    assert list(session.lean(run)([10, 20])) == [2_000_000, 4_000_000]
    assert held() < before + 10
    sent, of = [], type(spark.sparkContext)
    monkeypatch.setattr(of, "broadcast", lambda self, value, f=of.broadcast: sent.append(value) or f(self, value))
    packing.pack(spark.createDataFrame([(k, f"alpha beta {k}") for k in range(5)], "doc_id long, text string"))
    assert len(sent) == 1
