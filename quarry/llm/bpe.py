"""Byte-level BPE: overlapping chunk encoding, and decoding by concatenation of raw bytes.

Long texts are dealt out as chunks that overlap. Each chunk is cut into pre-tokens on its own;
the cuts of two neighbouring chunks are stitched at the first place in their overlap where both
cut at the same position (from there on they agree, as a pre-token depends only on what
follows its start). Where an overlap has no such place, the text is cut whole. The
pieces are then encoded one by one, every distinct piece once per worker.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes;
repeated rows are each encoded; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .session import cut as cut_, documents

#: Code points of a chunk without its overlap, and of the overlap on its right.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Distinct pieces that a worker remembers; when full, it begins anew.
MEMORY = 400_000


def tables(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(pattern: regex.Pattern, text: str) -> list[str]:
    """The pre-tokens of a text; the pattern leaves no character out."""
    return pattern.findall(text)


def stitched(pattern: regex.Pattern, chunks: list[str], overlap: int = OVERLAP) -> list[str]:
    """The pre-tokens of a text from those of its chunks, each of which reaches `overlap` code points into the next."""
    if len(chunks) == 1:
        return cuts(pattern, chunks[0])
    out: list[str] = []
    skip = 0  # code points of this chunk that the chunks before it have yielded
    for k, chunk in enumerate(chunks):
        pieces = cuts(pattern, chunk)
        ends = np.cumsum([0, *map(len, pieces)])
        lo = int(np.searchsorted(ends, skip))
        if ends[lo] != skip:
            return cuts(pattern, "".join(c[:-overlap] for c in chunks[:-1]) + chunks[-1])
        if k + 1 == len(chunks):
            return out + pieces[lo:]
        # both sides' boundaries in the overlap, short of its last piece, which the chunk's end may have cut
        base = len(chunk) - overlap
        mine = ends[(ends >= max(base, skip)) & (ends < ends[-2] if len(pieces) > 1 else ends < 0)] - base
        other = np.cumsum([0, *map(len, cuts(pattern, chunks[k + 1][: 2 * overlap]))])
        # the first boundary of the next chunk may be an accident of its start; it counts if this chunk has it too
        both = np.intersect1d(mine, other[other < overlap])
        if not len(both):
            return cuts(pattern, "".join(c[:-overlap] for c in chunks[:-1]) + chunks[-1])
        hi = int(np.searchsorted(ends, base + both[0]))
        out += pieces[lo:hi]
        skip = int(both[0])
    return out


class Pieces(dict):
    """The ids of a piece as little-endian unsigned 32-bit integers, remembered."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.raw = np.array([b""] * (max(ranks.values()) + 1), object)
        for b, r in ranks.items():
            self.raw[r] = b

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.codec._encode_single_piece(piece), "<u4").tobytes()
        if len(self) < MEMORY:
            self[piece] = ids
        return ids

    def encode(self, chunks: list[str], overlap: int = OVERLAP) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, stitched(self.pattern, chunks, overlap))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.raw[ids].tolist())


@functools.cache
def codec(ranks_path: str, pattern: str) -> Pieces:
    return Pieces(ranks_path, pattern)


def chunked(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The text in chunks that overlap by as many code points; a last part no longer than the overlap stays with its neighbour."""
    n = max(1, -(-(len(text) - overlap) // size))
    return [text[k * size : (k + 1) * size + overlap if k + 1 < n else None] for k in range(n)]


def encode(
    docs: DataFrame, text_col: str = "text", *, keep: tuple[str, ...] = ("doc_id",), ranks_path: str | None = None, pattern: str | None = None, size: int = CHUNK, overlap: int = OVERLAP,
    coder: Callable[[], Pieces] | None = None,
) -> DataFrame:
    """The kept columns, ids (array of ints) and decoded (binary: the bytes of the ids) of every text.

    Texts of one chunk are encoded where they are read. The chunks of longer texts are dealt out.
    coder: gives a worker's codec, where it isn't the one of the ranks.
    """
    import public_tokenizers

    coder = coder or functools.partial(codec, ranks_path or tables(), pattern or public_tokenizers.PATTERN)
    rows = docs.select(*keep, F.coalesce(text_col, F.lit("")).alias("__text"))
    length = F.length("__text")
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [own.encode([x]) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], _lists(ids), pa.array([own.decode(x) for x in ids], pa.binary())], [*keep, "ids", "decoded"])

    short = rows.where(length <= size + overlap).mapInArrow(run, f"{kept}, ids array<int>, decoded binary")
    return short.unionByName(_encode_long(rows.where(length > size + overlap), keep, kept, coder, size, overlap))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32)))


def _encode_long(rows: DataFrame, keep: tuple[str, ...], kept: str, coder: Callable[[], Pieces], size: int, overlap: int) -> DataFrame:
    """The same for texts of several chunks, each a row: cut on its own, stitched with its neighbours, encoded between the stitches."""
    n = F.ceil((F.length("__text") - overlap) / size).cast("int")
    chunk = lambda k: F.substr("__text", k * size + 1, F.when(k + 1 < n, size + overlap).otherwise(F.length("__text")))
    rows = rows.withColumns({"__uid": F.monotonically_increasing_id(), "__n": n})
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.select(*keep, "__uid", "__n", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), chunk)).alias("__k", "__chunk"))
    chunks = cut_(chunks.repartition(partitions, "__uid", "__k"), "chunks")  # written once: numbers of rows mustn't be given anew
    names = [*keep, "__uid", "__n", "__k", "__chunk"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = coder().pattern
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                heads, tails = [], []
                for text in part.column(len(names) - 1).to_pylist():
                    ends = np.cumsum([0, *map(len, cuts(find, text))])
                    heads.append(ends[ends < overlap])
                    tails.append(ends[(ends >= size) & (ends < ends[-2])] - size)  # the chunk's end may have cut its last piece
                yield pa.RecordBatch.from_arrays([*part.columns[-4:-1], _lists(heads), _lists(tails)], ["__uid", "__n", "__k", "__head", "__tail"])

    ends = chunks.mapInArrow(cut, "__uid long, __n int, __k int, __head array<int>, __tail array<int>")
    order = W.partitionBy("__uid").orderBy("__k")
    ends = ends.withColumn("__stop", F.array_min(F.array_intersect("__tail", F.lead("__head").over(order)))).drop("__head", "__tail")
    lost = F.max((F.col("__stop").isNull() & (F.col("__k") + 1 < F.col("__n"))).cast("int")).over(W.partitionBy("__uid"))
    # a few numbers a chunk meet in a text's window; the chunks themselves are joined to them where they lie
    stops = ends.select(F.col("__uid").alias("__u"), F.col("__k").alias("__c"), "__stop", F.coalesce(F.lag("__stop").over(order), F.lit(0)).alias("__begin"), lost.alias("__lost"))
    stitched_ = chunks.join(stops, (F.col("__uid") == F.col("__u")) & (F.col("__k") == F.col("__c"))).select(*names, "__stop", "__begin", "__lost")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                out, whole = [], []
                for text, stop, begin, missing in zip(*(part.column(len(names) - 1 + k).to_pylist() for k in range(4))):
                    whole.append(text if missing else None)
                    pieces = [] if missing else cuts(own.pattern, text)
                    at = np.cumsum([0, *map(len, pieces)])
                    last = len(pieces) if stop is None else int(np.searchsorted(at, size + stop))
                    out.append(np.frombuffer(b"".join(own[p] for p in pieces[int(np.searchsorted(at, begin)) : last]), "<u4"))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names) - 1], pa.array(whole, pa.string()), _lists(out)], [*names, "__ids"])

    parts = stitched_.mapInArrow(between, f"{kept}, __uid long, __n int, __k int, __chunk string, __ids array<int>")
    sorted_ = F.sort_array(F.collect_list(F.struct("__k", "__ids", "__chunk")))
    texts = parts.groupBy("__uid").agg(*(F.first(c).alias(c) for c in keep), sorted_.alias("__all"))
    texts = texts.select(*keep, F.flatten(F.transform("__all", lambda x: x["__ids"])).alias("ids"), F.transform("__all", lambda x: x["__chunk"]).alias("__chunks"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                ids, chunks = part.column(len(keep))[0].values.to_numpy(), part.column(len(keep) + 1).to_pylist()[0]
                if chunks[0] is not None:  # no common cut in some overlap: the text as one
                    ids = own.encode(["".join(c[:-overlap] for c in chunks[:-1]) + chunks[-1]])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], _lists([ids]), pa.array([own.decode(ids)], pa.binary())], [*keep, "ids", "decoded"])

    return texts.mapInArrow(finish, f"{kept}, ids array<int>, decoded binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(documents(spark, sf_dir))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw = b.column(1), b.column(2)
            n = pa.compute.list_value_length(ids).cast(pa.int64())
            sha = [hashlib.sha256(x.values.to_numpy().astype("<u4").tobytes()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), n, pa.array(sha, pa.string()), pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in raw], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
