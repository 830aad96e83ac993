"""Cross-tokenizer alignment: which tokens of two tokenizers end together, and how often each pair does so in the corpus.

Whitespace-token anchors: a text is encoded in full by both tokenizers. Ends that both share, each before a token that
begins with a space, cut it into windows of token ids. A window of one token on either side is one group; the others are cut into
groups by the further ends that both share. All windows of a text are worked on together, by column.

A is the byte-level BPE of `bpe`, by the rank file of its vocabulary, over a space and the text; B a sentencepiece model, which puts that space there
itself. No piece of B holds a space behind another character (looked at when it is loaded), so that text between such places is encoded by
itself, once per worker; a model that has such pieces encodes whole texts.

Defined cases: a text that is null, empty, or whose bytes A or B don't give back, has no tokens, and zeros; strings of
special tokens are plain text; repeated rows are each aligned and counted; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import bpe
from .session import cut, documents, fresh, sized

#: What counts as a space for B, and stretches that begin with spaces.
SPACE = "▁"
STRETCH = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
LINK = "array<struct<a:int,b:int,n:int>>"


def _both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of two ascending lists of byte offsets has those that both have."""
    n = max(a.max(initial=0), b.max(initial=0)) + 1
    in_a, in_b = np.zeros(n, bool), np.zeros(n, bool)
    in_a[a] = in_b[b] = True
    return np.flatnonzero(in_b[a]), np.flatnonzero(in_a[b])


class Bytes:
    """The bytes of each id in one table, its length, and whether it begins with a space."""

    def __init__(self, raw: list[bytes]) -> None:
        self.table, self.size = np.frombuffer(b"".join(raw), np.uint8), np.array([*map(len, raw)], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.spaced = np.array([r[:1] == b" " for r in raw])

    def join(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.table[np.repeat(self.first[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class Pieces(dict):
    """The ids of B of stretches that begin with a space, as signed 32-bit integers, remembered."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.raw = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.space = np.array([self.model.piece_to_id(SPACE)], np.int32).tobytes()
        self.old: dict[str, bytes] = {}

    def learn(self, stretches: list[str]) -> dict[str, bytes]:
        """Those that aren't remembered lately, encoded in one call if not remembered at all."""
        known = {x: y for x in stretches if x not in self and (y := self.old.get(x)) is not None}
        new = [x for x in dict.fromkeys(stretches) if x not in self and x not in known]
        ids = self.model.encode([x[1:] for x in new], num_threads=1) if new else []
        known |= {x: array("i", y).tobytes() if len(x) > 1 else self.space for x, y in zip(new, ids)}
        if len(self) >= bpe.MEMORY // 2:
            self.old = dict(self)
            self.clear()
        self.update(x for x in known.items() if len(x[0]) <= 256)
        return known

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, given with the space before it."""
        if not self.cuts:
            return np.array(self.model.encode(text[1:], num_threads=1), np.int32)
        stretches = STRETCH.findall(text)
        found = list(map(self.get, stretches))
        if None in found:
            new = self.learn([x for x, y in zip(stretches, found) if y is None])
            found = [new[x] if y is None else y for x, y in zip(stretches, found)]
        return np.frombuffer(b"".join(found), np.int32)


class Aligner:
    """A worker's tokenizers, and alignments of texts by both: (text of the groups, links as pairs of 32-bit integers)."""

    def __init__(self, a_path: str, pattern: str, b_path: str) -> None:
        self.a = bpe.codec(a_path, pattern)
        self.b = Pieces(b_path)
        self.a_bytes, self.b_bytes = Bytes(self.a.raw.tolist()), Bytes(self.b.raw)
        self.a_size, self.b_size = self.a_bytes.size.tolist(), self.b_bytes.size.tolist()
        self.names = [*map(str, range(max(len(self.a_size), len(self.b_size))))]
        # each id with what follows it, filled up with zero bytes: a token of its group, the last one of A, the last one of B
        wide = len(self.names[-1]) + 1
        self.told = np.array([[n + x for n in self.names] for x in ",|;"], f"S{-(-wide // 8) * 8}")

    def aligned(self, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
        """The same token by token, which `align` is held against: the side that is behind goes on to its next end; where both ends meet, a group is closed."""
        names, size_a, size_b = self.names, self.a_size, self.b_size
        groups, links = [], []
        i = j = from_a = from_b = 0
        end_a, end_b, last = size_a[a[0]], size_b[b[0]], len(a) - 1
        while True:
            if end_a < end_b:
                i += 1
                end_a += size_a[a[i]]
            elif end_b < end_a:
                j += 1
                end_b += size_b[b[j]]
            else:
                told_a = names[a[i]] if i == from_a else ",".join([names[x] for x in a[from_a : i + 1]])
                told_b = names[b[j]] if j == from_b else ",".join([names[x] for x in b[from_b : j + 1]])
                groups.append(f"{told_a}|{told_b}")
                links += a[i], b[j]
                if i == last:
                    return ";".join(groups).encode(), array("i", links).tobytes()
                i, j = i + 1, j + 1
                from_a, from_b = i, j
                end_a, end_b = end_a + size_a[a[i]], end_b + size_b[b[j]]

    def windows(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last token of each window on either side: verified anchors are ends that both have, each before a token with a space."""
        before_a, before_b = np.flatnonzero(self.a_bytes.spaced[a[1:]]), np.flatnonzero(self.b_bytes.spaced[b[1:]])
        at_a, at_b = _both(ends_a[before_a], ends_b[before_b])
        return np.append(before_a[at_a], len(a) - 1), np.append(before_b[at_b], len(b) - 1)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last token of each group on either side: those of the windows, and the further ends that both have in windows of several tokens on both."""
        ends_a, ends_b = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        last_a, last_b = self.windows(a, b, ends_a, ends_b)
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        several = (n_a > 1) & (n_b > 1)
        inner_a, inner_b = np.repeat(several, n_a), np.repeat(several, n_b)
        inner_a[last_a] = inner_b[last_b] = False
        inner_a, inner_b = np.flatnonzero(inner_a), np.flatnonzero(inner_b)
        at_a, at_b = _both(ends_a[inner_a], ends_b[inner_b])
        return np.sort(np.append(last_a, inner_a[at_a])), np.sort(np.append(last_b, inner_b[at_b]))

    def tell(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """The text of the groups: A's ids of a group stand before B's."""
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        kind_a, kind_b = np.zeros(len(a), np.int8), np.zeros(len(b), np.int8)
        kind_a[last_a], kind_b[last_b] = 1, 2
        out = np.empty(len(a) + len(b), self.told.dtype)
        out[np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)] = self.told[kind_a, a]
        out[np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)] = self.told[kind_b, b]
        return out.tobytes().translate(None, b"\0")[:-1]

    def align(self, text: str | None) -> tuple[int, int, bytes, np.ndarray]:
        """Tokens of A, of B, the text of the groups, and links as rows (a, b)."""
        none = (0, 0, b"", np.zeros((0, 2), np.int32))
        if not text:
            return none
        told, raw = " " + text, b" " + text.encode()
        b = self.b.encode(told)
        if self.b_bytes.join(b) != raw:
            return none
        a = self.a.encode([told]).astype(np.int32)
        if self.a_bytes.join(a) != raw:
            return none
        last_a, last_b = self.groups(a, b)
        return len(a), len(b), self.tell(a, b, last_a, last_b), np.stack([a[last_a], b[last_b]], 1)


@functools.cache
def aligner(a_path: str, pattern: str, b_path: str) -> Aligner:
    return Aligner(a_path, pattern, b_path)


def align(docs: DataFrame, text_col: str = "text", *, keep: tuple[str, ...] = ("doc_id",), a_path: str | None = None, b_path: str | None = None, pattern: str | None = None, digest: bool = False) -> DataFrame:
    """The kept columns, n_a, n_b, groups (`a1,a2|b1;...`; digest: its SHA-256 where there are tokens), links (each pair of ids of the text with its times)."""
    import public_tokenizers

    own = functools.partial(aligner, a_path or bpe.tables(), pattern or public_tokenizers.PATTERN, b_path or bpe.tables("piece_bpe_32k.model"))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    link = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = own()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                n_a, n_b, groups, pairs, times, ends = [], [], [], [], [], [0]
                for text in part.column(len(keep)).to_pylist():
                    a, b, told, links = tools.align(text)
                    key, n = np.unique(links[:, 0].astype(np.int64) << 32 | links[:, 1], return_counts=True)
                    n_a.append(a)
                    n_b.append(b)
                    groups.append(hashlib.sha256(told).hexdigest() if digest and a else told.decode())
                    pairs.append(key)
                    times.append(n)
                    ends.append(ends[-1] + len(key))
                key = np.concatenate(pairs)
                values = pa.StructArray.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array(key.astype(np.int32)), pa.array(np.concatenate(times).astype(np.int32))], fields=list(link.value_type))
                out = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(link)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *out], [*keep, "n_a", "n_b", "groups", "links"])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`")).mapInArrow(run, f"{kept}, n_a long, n_b long, groups string, links {LINK}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count of each pair of ids over all texts, and whether no other pair of its B id has more. A B id has at most as many pairs as A has ids."""
    each = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("count"))
    return each.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("b")))


def scored(aligned: DataFrame) -> DataFrame:
    """aligned, written once, with n_links, n_best and count_sum in the place of its links.

    Pairs of a text are one row each with their times, so texts of one pair over and over weigh no more than others. They meet the corpus-wide counts
    by broadcast while those are small, else by a shuffle, whose hot pairs are split while it runs.
    """
    uid, = fresh(aligned, "uid")
    aligned = cut(aligned.withColumn(uid, F.monotonically_increasing_id()), "aligned")  # written: numbers of rows mustn't be given anew
    counts = cut(pair_counts(aligned), "pairs")
    links = aligned.select(F.col(uid).alias("uid"), F.inline("links")).join(sized(counts, 48), ["a", "b"])
    n, times = F.col("n").cast("long"), F.col("n") * F.col("count")
    sums = links.groupBy("uid").agg(F.sum(n).alias("n_links"), F.sum(F.when(F.col("best"), n).otherwise(0)).alias("n_best"), F.sum(times).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(f"sums.{c}"), F.lit(0).cast("long")).alias(c)
    rows = aligned.drop("links").alias("rows").join(sums.alias("sums"), F.col(f"rows.{uid}") == F.col("sums.uid"), "left")
    return rows.select(*(F.col(f"rows.`{c}`") for c in aligned.columns if c not in (uid, "links")), *map(zero, ("n_links", "n_best", "count_sum")))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(align(documents(spark, sf_dir), digest=True))
    return rows.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
