"""Packing: documents fill training sequences together with their lexical neighbours.

Documents are dealt to shards by their words, tokenised and packed shard by shard. Each shard has an inverted index whose
BM25 weights come from document frequencies and lengths over all documents. A seed document's query is all its words;
the index returns unused neighbours in the order of their scores, which greedily fill the seed's window of MOST tokens.
A document that doesn't fit is cut: what is left of it is the next window's seed. When nothing scores, the next unused
document follows. A shard's last, unfilled window is cut into lengths that are powers of two, which need no padding.

A document's topic is the word of the most weight among those of at least one in COMMON documents. Its key is the word of
the most weight among those that a shard can hold all documents of; where it has none, its rarest shared word, whose
documents are dealt by their ids. The keys of a topic are dealt by hash to as many groups as the topic needs, and a
group's rows in order make its shards: what is packed together depends on the rows only, not on files or partitions.
Frequencies are counted by hash in cells, so that words that share a cell have their frequencies added. Neighbours are
looked for within a shard.

Tokens: those of a `tokenizers` file of byte-level BPE. Texts of a batch are cut into pre-tokens by a few
numpy passes over their code points; every distinct pre-token is
encoded once per worker; two of one 64-bit hash in a batch are told apart by their code points, and what is remembered
is looked up by the pre-token itself. A text that holds a special token of the file is left to the tokenizer itself.

Defined cases: a null text counts as empty; an empty text is its end token alone; repeated rows are packed
each; null ids are allowed; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnp
from .lexicon import Statistics, cells, counted, statistics
from .session import cut, documents, lean

#: Tokens of a sequence, and the id that ends a document.
MOST, END = 2048, 1
#: A shard is closed when it has so many tokens or documents.
SHARD_TOKENS, SHARD_DOCS = 1_500_000, 1024
#: A topic is a word of at least one in so many documents.
COMMON = 8
#: Distinct pre-tokens that a worker remembers; when full, it begins anew.
MEMORY = 500_000

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@functools.cache
def kinds() -> np.ndarray:
    """Of every code point whether it is a letter, a number, white space or other."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        out[c] = LETTER if k == "L" else NUMBER if k == "N" else OTHER
    # The code points of Unicode's property White_Space.
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def pretokens(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens. points: code points of texts one after the other; first: marks where a text begins.

    A run of one kind is a token, with the space before it. White space before a word keeps its
    last character apart. An apostrophe right after something else than a space begins an English ending.
    """
    n = len(points)
    kind = kinds()[points]
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    blank = points == 32
    joins = np.zeros(n, bool)  # a run that takes the space before it
    joins[1:] = change[1:] & ~first[1:] & (kind[1:] != SPACE) & blank[:-1]
    start[joins] = False
    # a run's last white space before another character of the same text stands apart
    apart = np.zeros(n, bool)
    apart[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:]
    start |= apart
    at = np.flatnonzero((points == 39) & start)  # no space was joined to it
    at = at[at + 1 < n]
    at = at[~first[at + 1] & (kind[at + 1] == LETTER)]
    a = points[at + 1]
    after = np.minimum(at + 2, n - 1)
    b = np.where((at + 2 < n) & ~first[after], points[after], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    start[at[one | two] + 1] = False
    ends = np.concatenate([at[one] + 2, at[two] + 3])
    ends = ends[ends < n]
    start[ends[kind[ends] == LETTER]] = True
    return np.flatnonzero(start)


class Tokenizer:
    """Ids of many texts at once."""

    def __init__(self, path: str, ranks_path: str | None = None) -> None:
        """ranks_path: the same vocabulary as ranks, by which single pre-tokens are encoded faster to the same ids."""
        from tokenizers import Tokenizer as Reader

        self.reader = Reader.from_file(path)
        self.ranks = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", ())]
        self.forget()

    def forget(self) -> None:
        """Begins anew: of every remembered pre-token its number, and where its ids stand."""
        self.memory: dict[str, int] = {}
        self.begin, self.size, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    def places(self, pieces: list[str]) -> np.ndarray:
        """The numbers of pre-tokens, which are encoded where they aren't remembered."""
        if len(self.memory) > MEMORY:
            self.forget()
        get = self.memory.get
        out = [get(p, -1) for p in pieces]
        for k in [k for k, x in enumerate(out) if x < 0]:
            out[k] = get(pieces[k], -1)
            if out[k] >= 0:
                continue
            ids = self.piece(pieces[k])
            x = out[k] = self.memory[pieces[k]] = len(self.memory)
            if x == len(self.size):
                self.begin, self.size = (np.append(a, np.zeros_like(a)) for a in (self.begin, self.size))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.append(self.flat, np.zeros_like(self.flat))
            self.begin[x], self.size[x], self.flat[self.used : self.used + len(ids)] = self.used, len(ids), ids
            self.used += len(ids)
        return np.array(out, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.reader.encode(text, add_special_tokens=False).ids, np.uint32)

    def piece(self, text: str) -> list[int]:
        return self.ranks._encode_single_piece(text) if self.ranks else self.reader.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids and their ends per text; hashes of the words (pre-tokens) and their ends per text."""
        n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(points), bool)
        begin = np.cumsum(lengths) - lengths
        first[begin[lengths > 0]] = True
        start = pretokens(points, first)
        end = np.append(start[1:], len(points))
        wide = 4 if points.max(initial=0) > 255 else 1  # bytes of a code point here
        data = points.view(np.uint8) if wide == 4 else points.astype(np.uint8)
        h = textnp.short_hashes(data, start * wide, end * wide)
        at, inverse = textnp.alike(data, start * wide, end * wide, h)
        known = self.places([joined[lo:hi] for lo, hi in zip(start[at].tolist(), end[at].tolist())])[inverse]
        own = self.size[known]
        place = np.cumsum(own) - own
        ids = self.flat[np.repeat(self.begin[known] - place, own) + np.arange(own.sum())]
        row = np.searchsorted(np.cumsum(lengths), start, "right")
        word_ends = np.searchsorted(row, np.arange(1, n + 1))
        id_ends = np.append(0, np.cumsum(own))[word_ends]
        if any(s in t for s in self.special for t in texts):
            parts = np.split(ids, id_ends[:-1])
            parts = [self.whole(t) if any(s in t for s in self.special) else p for t, p in zip(texts, parts)]
            ids, id_ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, id_ends, h, word_ends


@functools.cache
def tokenizer(path: str, ranks_path: str | None = None) -> Tokenizer:
    return Tokenizer(path, ranks_path)


def keys(known: Statistics, word: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every text the topic and the key that it is dealt by, or -1."""
    length = np.bincount(row, minlength=n_rows)
    row, word, tf = counted(word, row)
    df = known.df[word]
    weight = known.weights(word, tf, length[row])

    def best(where: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.full(n_rows, -1, np.int64)
        r, w, weight = row[where], word[where], weight[where]
        if len(r):  # rows are in order
            new = np.concatenate([[True], r[1:] != r[:-1]])
            edge = np.flatnonzero(new)
            most = np.maximum.reduceat(weight, edge)[np.cumsum(new) - 1]
            out[r[edge]] = np.maximum.reduceat(np.where(weight == most, w, -1), edge)
        return out

    return best(df * COMMON >= known.n, weight), best(df > 1, np.where(df <= SHARD_DOCS, weight, -df))


def dealt(rows: DataFrame, known: Statistics, shared: Broadcast | None = None) -> DataFrame:
    """Rows (group, key, h, id, text) dealt and sorted by the group and the key of each. shared: the statistics, where they are broadcast already.

    Topics and keys are found once and written with the rows, so that all rows of a topic are counted before any is dealt.
    """
    shared = shared or rows.sparkSession.sparkContext.broadcast(known)
    rows = rows.withColumn("h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnp.slices(batch):
                topic, key = keys(shared.value, *cells(part.column(1)), part.num_rows)
                many = np.where(key < 0, shared.value.n, shared.value.df[key])
                many = np.where(many > SHARD_DOCS, -(-2 * many // SHARD_DOCS), 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(topic), pa.array(key), pa.array(many)], ["id", "text", "h", "topic", "key", "many"])

    keyed = rows.mapInArrow(lean(run), "id long, text string, h long, topic long, key long, many long")
    place, n = [], 1  # group 0 is for tables that one shard can hold
    if known.n > SHARD_DOCS:
        keyed = cut(keyed, "keyed")
        # topics are few: a text of so many words is in at most COMMON times as many
        for topic, size in sorted(keyed.groupBy("topic").count().collect()):
            place.append((topic, n, -(-4 * size // (3 * SHARD_DOCS))))
            n += place[-1][2]
    told = rows.sparkSession.createDataFrame(place, "topic long, first long, parts long")
    share = F.pmod(F.xxhash64("id", "h"), F.col("many"))
    group = F.coalesce("first", F.lit(0)) + F.pmod(F.xxhash64("key", share), F.coalesce("parts", F.lit(1)))
    keyed = keyed.join(F.broadcast(told), "topic", "left")
    return keyed.select(group.alias("group"), "key", "h", "id", "text").repartition("group").sortWithinPartitions("group", "key", "h", "id")


class Shard:
    """A bounded number of documents with their index, weighted by the statistics of all documents."""

    def __init__(self, words: list[np.ndarray], known: Statistics) -> None:
        n = len(words)
        length = np.array([len(w) for w in words])
        row = np.repeat(np.arange(n), length)
        distinct, term = np.unique(np.concatenate([*words, np.zeros(0, np.int64)]), return_inverse=True)
        n_terms = len(distinct)
        key, tf = np.unique(term * n + row, return_counts=True)
        term, doc = key // n, key % n
        weight = known.weights(distinct[term], tf, length[doc])
        keep = np.bincount(term, minlength=n_terms)[term] > 1  # a term of one document has no neighbour to find
        term, doc, weight = term[keep], doc[keep], weight[keep]
        self.n, self.doc, self.weight = n, doc, weight
        self.begin = np.searchsorted(term, np.arange(n_terms + 1))
        order = np.argsort(doc, kind="stable")
        self.terms = np.split(term[order], np.searchsorted(doc[order], np.arange(1, n)))
        self.unused = np.ones(n, bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a word with the seed, best first."""
        terms = self.terms[seed]
        lo, hi = self.begin[terms], self.begin[terms + 1]
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        score = np.bincount(self.doc[at], self.weight[at], self.n) * self.unused
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def fill(sizes: list[int], shard: Shard, most: int = MOST) -> list[tuple[int, int, int, int, int]]:
    """Pieces (sequence, offset, document, start, length) of all documents of a shard, in order."""
    out, sequence, offset, next_ = [], 0, 0, 0
    seed, waiting = -1, np.zeros(0, np.int64)
    for _ in range(len(sizes)):
        while len(waiting) and not shard.unused[waiting[0]]:
            waiting = waiting[1:]
        if len(waiting):
            doc = int(waiting[0])
        else:
            while not shard.unused[next_]:
                next_ += 1
            doc = next_
        shard.unused[doc] = False
        window, start = sequence, 0
        while start < sizes[doc]:
            n = min(most - offset, sizes[doc] - start)
            out.append((sequence, offset, doc, start, n))
            start, offset = start + n, offset + n
            if offset == most:
                sequence, offset = sequence + 1, 0
        if seed < 0 or sequence != window or not len(waiting):  # a new window begins with what is left of this one
            seed = doc
            waiting = shard.neighbours(seed)
    if offset:  # the last window, in powers of two
        last = [p for p in out if p[0] == sequence]
        out = out[: len(out) - len(last)]
        ends, done = [], 0
        for bit in reversed(range(offset.bit_length())):
            if offset >> bit & 1:
                done += 1 << bit
                ends.append(done)
        begin = 0
        for end in ends:
            for _, o, doc, start, n in last:
                lo, hi = max(o, begin), min(o + n, end)
                if lo < hi:
                    out.append((sequence, lo - begin, doc, start + lo - o, hi - lo))
            sequence, begin = sequence + 1, end
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, ranks_path: str | None = None, most: int = MOST, end: int = END) -> DataFrame:
    """id, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens, sequence_id, offset of every piece."""
    if path is None:
        import public_tokenizers

        path, ranks_path = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    known = statistics(rows)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def close(held: list, base: int) -> tuple[Iterator[pa.RecordBatch], int]:
        pieces = fill([len(x[1]) for x in held], Shard([x[2] for x in held], shared.value), most)
        out = []
        for k in range(0, len(pieces), 1000):
            part = pieces[k : k + 1000]
            columns = [
                pa.array([held[d][0] for _, _, d, _, _ in part], pa.int64()),
                pa.array([s for _, _, _, s, _ in part], pa.int64()),
                pa.array([n for *_, n in part], pa.int64()),
                pa.array([held[d][1][s : s + n].astype("<u4").tobytes() for _, _, d, s, n in part], pa.binary()),
                pa.array([len(held[d][1]) for _, _, d, _, _ in part], pa.int64()),
                pa.array([base + q for q, *_ in part], pa.int64()),
                pa.array([o for _, o, *_ in part], pa.int64()),
            ]
            out.append(pa.RecordBatch.from_arrays(columns, names))
        return out, base + pieces[-1][0] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, ranks_path)
        held: list = []
        base = size = 0
        group = -1
        for batch in batches:
            for part in textnp.slices(batch, most=1 << 20):
                texts = part.column(2)
                ids, id_ends, _, _ = own.encode(texts.to_pylist())
                word, row = cells(texts)
                word_ends = np.searchsorted(row, np.arange(1, part.num_rows))
                for g, i, x, w in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), np.split(ids, id_ends[:-1]), np.split(word, word_ends)):
                    if held and (g != group or size >= SHARD_TOKENS or len(held) >= SHARD_DOCS):
                        out, base = close(held, base)
                        yield from out
                        held, size = [], 0
                    if g != group:
                        group, base = g, g << 32
                    held.append((i, np.append(x, np.uint32(end)), w))
                    size += len(x) + 1
        if held:
            yield from close(held, base)[0]

    return dealt(rows, known, shared).select("group", "id", "text").mapInArrow(lean(run), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
