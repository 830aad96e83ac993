"""Byte-level BPE by backtracking: exact merges in linear time, and decoding by a table of offsets.

A sequence of tokens is what the merges make of a text exactly if each two neighbours are compatible, that is if the
merges make those two tokens of the bytes of both. So a pre-token is read from left to right: the longest token that an
Aho-Corasick automaton matches here is taken if it goes with the token before it; else the next
shorter one; if none is left, the last token is taken back and its end is marked as a dead end. Every place is left at
most once that way, so the time is linear in the length. Compatibility is told by taking the two tokens' merges back, last one first.

Strings of added tokens are cut out of a text first. Texts of several chunks are cut and stitched as in `bpe`.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to an empty text; repeated rows are each
encoded; other columns are ignored; an empty table gives an empty result; ids that are no valid UTF-8 together decode with
U+FFFD in the place of what is broken.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .session import documents

#: Pairs whose compatibility a worker remembers; when full, it begins anew.
PAIRS = 1_000_000
BITS = 24


def tables(name: str = "byte_bpe_50k.json") -> str:
    return bpe.tables(name)


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Cutter:
    """Pre-tokens of a text from which the strings of added tokens were cut out."""

    def __init__(self, pattern: str, added: list[str]) -> None:
        self.pattern, self.added = regex.compile(pattern), added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def findall(self, text: str) -> list[str]:
        if not any(a in text for a in self.added):
            return self.pattern.findall(text)
        return [p for k, part in enumerate(self.split.split(text)) for p in ([part] if k % 2 else self.pattern.findall(part))]


class Merges:
    """The tokens of a vocabulary, how each was merged, and which of them go next to each other."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]) -> None:
        letters = byte_letters()
        raw = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        n = max(raw) + 1
        self.raw = [raw.get(i, b"") for i in range(n)]
        #: Merge number of each token, -1 for bytes and added ones; its parts; numbers of merges by the parts.
        self.rank, self.left, self.right, self.joins = [-1] * n, list(range(n)), list(range(n)), {}
        self.fit: dict[int, bool] = {}
        whole = [len(self.raw[i]) == 1 for i in range(n)]  # tokens that the merges make of their own bytes
        for k, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if max(self.rank[x], self.rank[y]) >= k or not (whole[x] and whole[y]) or self.rank[made] >= 0:
                raise ValueError(f"merge {k} comes before its parts or makes a token that another one makes")
            self.rank[made], self.left[made], self.right[made] = k, x, y
            self.joins[x << BITS | y] = k
            whole[made] = self.apart(x, y, k)
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            if whole[i]:
                self.automaton.add_word(self.raw[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.size = list(map(len, self.raw))
        self.shorter = [self._prefix(i) for i in range(n)]

    def _prefix(self, token: int) -> int:
        """The longest token that begins this one and is shorter; -1: none."""
        text = self.raw[token].decode("latin-1")
        return next((i for i in (self.automaton.get(text[:k], -1) for k in range(len(text) - 1, 0, -1)) if i >= 0), -1)

    def apart(self, x: int, y: int, limit: int) -> bool:
        """Whether none of the merges before `limit` joins two neighbours: their own merges are taken back, the last one first.

        Of equal merges the one further left comes first: the right token's own merge comes after one over the boundary.
        """
        rank, joins = self.rank, self.joins
        while True:
            joined = joins.get(x << BITS | y)
            if joined is not None and joined < limit:
                return False
            if rank[x] > rank[y]:
                limit, x = rank[x], self.right[x]
            elif rank[y] >= 0:
                limit, y = rank[y] + 1, self.left[y]
            else:
                return True

    def fits(self, x: int, y: int) -> bool:
        key = x << BITS | y
        known = self.fit.get(key)
        if known is None:
            if len(self.fit) >= PAIRS:
                self.fit.clear()
            known = self.fit[key] = self.apart(x, y, len(self.rank))
        return known

    def encode(self, text: str) -> list[int]:
        """The tokens of a pre-token, given with a character per byte."""
        n, at, ids = len(text), 0, []
        dead: set[int] = set()
        longest, size, shorter, fit = self.automaton.iter_long, self.size, self.shorter, self.fit
        token = next(longest(text))[1] if n else -1
        while at < n:
            if token < 0:  # nothing goes on from here: one token back, and on with the next shorter one
                dead.add(at)
                token = ids.pop()
                at -= size[token]
                token = shorter[token]
            elif at + size[token] not in dead and (not ids or fit.get(ids[-1] << BITS | token) or self.fits(ids[-1], token)):
                ids.append(token)
                at += size[token]
                token = next(longest(text, at))[1] if at < n else -1
            else:
                token = shorter[token]
        return ids


class Backtracker(bpe.Pieces):
    """A worker's codec: ids of distinct pre-tokens, remembered, and the bytes of all tokens in one table."""

    def __init__(self, path: str, pattern: str, specials: bool) -> None:
        dict.__init__(self)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their surroundings aren't known here")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        self.merges = Merges({t: i for t, i in told["model"]["vocab"].items() if t not in added}, merges, added)
        self.added = added if specials else {}
        self.pattern = Cutter(pattern, list(added)) if specials else regex.compile(pattern)
        self.table = np.frombuffer(b"".join(self.merges.raw), np.uint8)
        self.offsets = np.cumsum([0, *self.merges.size])

    def __missing__(self, piece: str) -> bytes:
        known = self.added.get(piece)
        ids = np.array(self.merges.encode(piece.encode().decode("latin-1")) if known is None else [known], "<u4").tobytes()
        if len(self) >= bpe.MEMORY:
            self.clear()
        self[piece] = ids
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids: each one's stretch of the table."""
        ids = ids.astype(np.int64)
        first, n = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(n)
        return self.table[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@functools.cache
def backtracker(path: str, pattern: str, specials: bool = True) -> Backtracker:
    return Backtracker(path, pattern, specials)


def encode(docs: DataFrame, text_col: str = "text", *, keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str | None = None, specials: bool = True, **chunks: int) -> DataFrame:
    """The kept columns, ids and decoded (binary) of every text; specials: strings of added tokens stand for those tokens."""
    import public_tokenizers

    coder = functools.partial(backtracker, path or tables(), pattern or public_tokenizers.PATTERN, specials)
    return bpe.encode(docs, text_col, keep=keep, coder=coder, **chunks)


def op11_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(documents(spark, sf_dir))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            ids, raw = b.column(1), b.column(2)
            told = [sha(",".join(map(str, x.values.to_numpy().tolist())).encode()) for x in ids]
            text = [sha(x.as_py().decode("utf-8", "replace").encode()) for x in raw]
            n = pa.compute.list_value_length(ids).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(told, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
