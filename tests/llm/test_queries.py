"""Each query against a brute-force version, over tables with null, empty, long and repeated texts and clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import queries as Q

WORD = r"[^\x20\x09-\x0D]+"


def run(spark, folder, prefix):
    (name,) = [n for n in Q.queries() if n.startswith(prefix)]
    return [r.asDict() for r in Q.queries()[name](spark, folder).collect()]


def by_id(found):
    out = defaultdict(list)
    for r in found:
        out[r["doc_id"]].append(r)
    return out


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, none, name):
    assert Q.queries()[name](spark, none).collect() == []


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_fingerprints(spark, folder, rows):
    got = run(spark, folder, "op1_")
    assert len(got) == len(rows)
    plain = [(i, t or "") for i, t, *_ in rows if i is not None and Counter(r[0] for r in rows)[i] == 1]
    texts = {i: t for i, t in plain}
    order = sorted({r[0] for r in rows if r[0] is not None})
    found = by_id(got)
    same = defaultdict(set)
    for i, t in texts.items():
        r = found[i][0]
        assert r["n_chars"] == len(t)
        same[t].add(r["fingerprint"])
        k = order.index(i)
        if k + 1 < len(order) and order[k + 1] in texts:
            after = texts[order[k + 1]]
            n = len(t) // 4
            edited = t[: len(t) - n] + after[:n]
            assert r["edited_sha256"] == sha(edited.encode())
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            if edited == t:
                assert r["near_edited"] == 1
            if after == t:
                assert r["near_next"] == 1
    assert all(len(x) == 1 for x in same.values())
    long = [r for r in got if r["n_chars"] > 3000 and r["n_retained"] > 30]
    assert np.mean([r["near_edited"] for r in long]) > 0.6


def test_licenses(spark, folder, rows):
    found = by_id(run(spark, folder, "op2_"))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        at = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = found[i][0]
        want = (len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert {x for _, x in at} <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert found[900010][0]["labels"] == "cc-by,cc-by-4.0,gpl,gpl-3-or-later,mit"


def test_toxicity(spark, folder, rows, sf):
    got = run(spark, folder, "op3_")
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)


def test_near_duplicates(spark, folder, rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    members = defaultdict(list)
    for i, t, *_ in rows:
        members[t or ""].append(i)
    texts, sets = list(members), []
    for t in texts:
        w = re.findall(WORD, t.translate(lower))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links, root = Counter(), list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    classes = defaultdict(list)
    for k, t in enumerate(texts):
        classes[top(k)] += [i for i in members[t] if i is not None]
    got = run(spark, folder, "op4_")
    want = [(i, min(classes[top(k)], default=None), links[k], len(members[t])) for k, t in enumerate(texts) for i in members[t]]
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got), key=str) == sorted(want, key=str)
    assert sum(links.values())


def test_quality(spark, folder, rows):
    found = by_id(run(spark, folder, "op5_"))
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(WORD, t)
        grams = list(zip(w, w[1:], w[2:]))
        n = Counter(grams)
        repeated = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        r = found[i][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_personal_data(spark, folder, rows):
    def luhn(s):
        return sum((int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(s))) % 10 == 0

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def passes(kind, v):
        digits = re.sub(r"\D", "", v)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()

    found = by_id(run(spark, folder, "op6_"))
    for i, t, *_ in rows:
        spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if passes(k, m.group())] for k, p in kinds]
        r = found[i][0]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(s) for s in spans]
        base = ",".join(x for s in spans for x in s)
        assert r["base_sha256"] == sha(base.encode()) and r["spans"].startswith(base)
    assert [len(by) for by in (found[900009],)] == [1] and found[900009][0]["n_ip"] == 1


def test_languages(spark, folder, rows):
    found = by_id(run(spark, folder, "op7_"))
    held = [(lang, found[i][0]["lang_pred"]) for i, t, lang, _ in rows if lang and found[i][0]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    for i in (900001, 900002, 900003):
        assert (found[i][0]["lang_pred"], found[i][0]["score"]) == ("und", 0)


def test_packing(spark, folder, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*reader.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[(i, len(ids))] += 1
    got = run(spark, folder, "op8_")
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    once = {i: t for i, t, *_ in rows if i != 900008}
    for i, t in once.items():
        ids = np.array([*reader.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(docs[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert sum(p["length"] for p in docs[900008]) == 2 * docs[900008][0]["doc_tokens"]


def test_byte_bpe(spark, folder, rows):
    from quarry.llm import bpe
    import public_tokenizers

    codec = bpe.codec(bpe.tables(), public_tokenizers.PATTERN).codec
    found = by_id(run(spark, folder, "op9_"))
    for i, t, *_ in rows:
        ids = np.array(codec.encode_ordinary(t or ""), "<u4")
        r = found[i][0]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(ids.tobytes()), sha((t or "").encode()))


def repeats(texts, window=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + window] for r in raw for k in range(len(r) - window + 1))
    out = []
    for r in raw:
        covered = np.zeros(len(r), bool)
        for k in range(len(r) - window + 1):
            if seen[r[k : k + window]] > 1:
                covered[k : k + window] = True
        edges = np.diff(np.concatenate([[0], covered.astype(int)])) == 1
        out.append((len(r), int(covered.sum()), int(edges.sum()), sha(np.frombuffer(r, np.uint8)[~covered].tobytes())))
    return out


def test_substrings(spark, folder, rows):
    got = run(spark, folder, "op10_")
    want = [(i, *x) for (i, *_), x in zip(rows, repeats([t for _, t, *_ in rows]))]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == sorted(want, key=str)


def test_backtracking_bpe(spark, folder, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = by_id(run(spark, folder, "op11_"))
    for i, t, *_ in rows:
        ids = reader.encode(t or "", add_special_tokens=False).ids
        for r in found[i]:
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(reader.decode(ids, skip_special_tokens=False).encode()))
    assert sum(map(len, found.values())) == len(rows)


def plain_alignment(a_reader, b_reader, text):
    """Ids of both, and groups as (ids of A, ids of B), by sets of ends."""
    if not text:
        return [], [], []
    from quarry.llm import backtrack

    letters = backtrack.byte_letters()
    a, b = a_reader.encode(" " + text, add_special_tokens=False).ids, b_reader.encode(text)
    raw_a = [bytes(letters[c] for c in a_reader.id_to_token(i)) for i in a]
    raw_b = [bytes([int(b_reader.id_to_piece(i)[3:-1], 16)]) if b_reader.is_byte(i) else b_reader.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return [], [], []
    ends_a, ends_b = np.cumsum([*map(len, raw_a)]), np.cumsum([*map(len, raw_b)])
    both = np.intersect1d(ends_a, ends_b)
    cut_a, cut_b = ([0, *(np.searchsorted(e, both) + 1).tolist()] for e in (ends_a, ends_b))
    return a, b, [(a[x:y], b[z:w]) for x, y, z, w in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]


def test_tokenizer_alignment(spark, folder, rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a_reader, b_reader = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_reader.encode_special_tokens = True
    want = [(i, *plain_alignment(a_reader, b_reader, t)) for i, t, *_ in rows]
    count = Counter((x[-1], y[-1]) for *_, groups in want for x, y in groups)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, a, b, groups in want:
        ns = [(count[x[-1], y[-1]], most[y[-1]]) for x, y in groups]
        told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(groups), sum(n == m for n, m in ns), sum(n for n, _ in ns), sha(told.encode()) if a else ""))
    got = run(spark, folder, "op12_")
    assert sorted((tuple(r.values()) for r in got), key=str) == sorted(out, key=str)
    assert any(n_b and best < n for _, _, n_b, n, _, best, *_ in out)


def levels_of(leaves):
    """All levels of a tree, each a list of digests."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2]).encode()) for k in range(0, len(out[-1]), 2)])
    return out


def way_up(levels, k):
    """(on the left, digest or None) on each level."""
    out = []
    for nodes in levels[:-1]:
        other = nodes[k ^ 1] if k ^ 1 < len(nodes) else None
        out.append((k % 2 == 1, other))
        k //= 2
    return out


def test_merkle_manifest(spark, folder, rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, t, lang, source, n: sha("".join(map(field, (i, source, lang, n, t))).encode())
    trees = defaultdict(list)
    for i, t, lang, source in rows:
        n = None if t is None else len(t)
        bad = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        trees[lang].append(((i is not None, i or 0, leaf(i, t, lang, source, n)), i, leaf(i, t, lang, source, n + bad if n is not None else n)))
    order = sorted(trees, key=lambda x: b"" if x is None else b"=" + x.encode())
    grown = {lang: levels_of([k[2] for k, *_ in sorted(trees[lang], key=lambda x: x[0])]) for lang in order}
    top = levels_of([grown[lang][-1][0] for lang in order])
    want = []
    for g, lang in enumerate(order):
        for k, (key, i, shown) in enumerate(sorted(trees[lang], key=lambda x: x[0])):
            way = way_up(grown[lang], k) + way_up(top, g)
            acc = shown
            for left, other in way:
                acc = sha((acc if other is None else other + acc if left else acc + other).encode())
            want.append((i, key[2], grown[lang][-1][0], top[-1][0], sha("".join(o or "" for _, o in way).encode()), acc, acc == top[-1][0]))
    got = run(spark, folder, "op13_")
    assert sorted((tuple(r.values()) for r in got), key=str) == sorted(want, key=str)
    assert {r["verified"] for r in got} == {True, False}
