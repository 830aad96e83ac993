"""Suffix-array dedup: every byte that a repeated 200-byte string covers is removed.

All suffixes of all texts can't be sorted in one place, so they are dealt out by content: each
200-byte window has an anchor, its smallest hash of 64 bytes (the leftmost, if equal), and equal windows
have equal anchors at the same place in them. The windows of a text thus fall into short segments, one per
anchor. Three steps, each linear in the text:

1. Counts of anchors, by Spark, with partial sums. An anchor met once repeats nothing: its segment is done.
2. Segments of repeated anchors, told apart by a 128-bit BLAKE2b digest of their bytes. Segments of one digest are one
   kind, and repeat as a whole if there are several; an anchor of one kind only is done.
3. Of the other anchors, one segment of each kind is fetched as bytes. Its windows' suffixes are sorted against those of
   the same anchor that have it at the same place, before anything is known of their equality: prefix polynomial hashes
   and binary search give the common extension of two suffixes in logarithmic time, a mergesort orders them by it, and
   neighbours that agree in 200 bytes are compared byte by byte, so that a collision of these hashes removes nothing.
   An anchor with more kinds than one task should hold (a passage met in very many contexts) has its windows grouped
   by their bytes themselves instead, with partial sums.

Defined cases: a null text counts as empty; texts under 200 bytes have nothing removed; all copies of a
repeated passage are removed, the first included; repeated rows remove each other; null ids are
allowed; other columns, whatever their names, are ignored here and kept by `remove_repeats`; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnp
from .session import cut, documents, fresh, lean, sized

WINDOW = 200
#: Bytes that an anchor's hash covers.
GRAM = 64
#: Kinds of segments of one anchor that are sorted in one task; beyond it windows are grouped by their bytes.
MOST_KINDS = 20_000
_LOW = np.uint64(0xFFFFFFFF)


def _segments(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """row, first window start (in data), number of windows, place of the anchor in the first one, anchor's hash."""
    n = len(data)
    if n < window:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    prefix = textnp.prefix_hashes(data)
    at = np.arange(n - gram + 1)
    grams = textnp.mix(textnp.span_hashes(prefix, at, at + gram))
    low = (grams & ~_LOW) | at.astype(np.uint64)
    width, span = 1, window - gram + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchor = (low & _LOW).astype(np.int64)  # of every window start
    valid = np.ones(len(anchor), bool)
    for end in offsets[1:-1]:
        valid[max(0, end - window + 1) : end] = False
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    lo = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    count = np.flatnonzero(last) + 1 - lo
    return np.searchsorted(offsets, lo, "right") - 1, lo, count, anchor[lo] - lo, grams[anchor[lo]]


def anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """a: the anchor of every segment. docs: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnp.slices(batch, most=1 << 20):  # some twenty arrays of 8 bytes a byte
                *_, a = _segments(*textnp.flat(part.column(0)), window, gram)
                for k in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000].view(np.int64))], ["a"])

    return docs.mapInArrow(lean(run), "a long")


def segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """a, s, t (anchor, digest of the bytes in two halves), id, h (of the row), lo (byte), n (windows), q (place of the anchor in the first) of every segment.

    docs: id, h, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnp.slices(batch, most=1 << 20):
                data, offsets = textnp.flat(part.column(2))
                row, lo, count, place, a = _segments(data, offsets, window, gram)
                raw = memoryview(data.tobytes())
                digests = b"".join([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(lo.tolist(), (lo + count + window - 1).tolist())])
                s, t = np.frombuffer(digests, np.int64).reshape(-1, 2).T
                of = pa.array(row)
                columns = [
                    pa.array(a.view(np.int64)), pa.array(s), pa.array(t), part.column(0).take(of), part.column(1).take(of),
                    pa.array((lo - offsets[row]).astype(np.int32)), pa.array(count.astype(np.int16)), pa.array(place.astype(np.int16)),
                ]
                for k in range(0, len(row), 100_000):
                    yield pa.RecordBatch.from_arrays([x.slice(k, 100_000) for x in columns], ["a", "s", "t", "id", "h", "lo", "n", "q"])

    return docs.mapInArrow(lean(run), "a long, s long, t long, id long, h long, lo int, n short, q short")


def common(prefix: np.ndarray, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common extensions of the suffixes at p and q, at most `most`, by binary search over prefix hashes."""
    pw, _ = textnp.powers(len(prefix) - 1)
    lo, hi = np.zeros(len(p), np.int64), np.full(len(p), most, np.int64)
    hp, hq, mp, mq = prefix[p], prefix[q], pw[q], pw[p]
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = (prefix[p + mid] - hp) * mp == (prefix[q + mid] - hq) * mq
        lo = np.where(same, mid, lo)
        hi = np.where(same, hi, mid - 1)
    return lo


def suffix_sort(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes at `at` within their groups (given in ascending order), by their first `most` bytes; stable.

    A mergesort of all groups at once: an element's place in a merged run is its place in its own half
    plus the number of elements of the other half before it, found by binary search.
    """
    order = np.arange(len(at))
    if not len(at):
        return order
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(edge, len(at)))
    first, rank = np.repeat(edge, size), np.arange(len(at)) - np.repeat(edge, size)
    size = np.repeat(size, size)
    width, own = 1, np.flatnonzero(size > 1)
    while len(own):
        f, r, n = first[own], rank[own], size[own]
        begin = r // (2 * width) * (2 * width)
        left = r - begin < width
        o_lo = np.where(left, np.minimum(begin + width, n), begin)
        lo, hi = o_lo.copy(), np.where(left, np.minimum(begin + 2 * width, n), np.minimum(begin + width, n))
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            x, y = at[order[own[open_]]], at[order[f[open_] + mid]]
            ext = common(prefix, x, y, most)
            more = np.minimum(ext, most - 1)
            before = np.where(ext == most, ~left[open_], data[y + more] < data[x + more])  # the other stands before this one
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        merged = order.copy()
        merged[f + begin + (r - begin - np.where(left, 0, width)) + (lo - o_lo)] = order[own]
        order = merged
        width *= 2
        own = own[size[own] > width]
    return order


def repeated_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows at `at` (ascending) equal another one of their group: neighbours among the sorted suffixes, all bytes compared."""
    found = np.zeros(len(at), bool)
    by = np.argsort(group, kind="stable")
    edge = np.concatenate([[True], group[by[1:]] != group[by[:-1]]])
    by = by[~(edge & np.append(edge[1:], True))]  # alone in its group
    if len(by) < 2:
        return found
    order = by[suffix_sort(data, textnp.prefix_hashes(data), at[by], group[by], window)]
    k = np.flatnonzero(group[order[1:]] == group[order[:-1]])
    x, y = at[order[k + 1]], at[order[k]]
    # a pair's bytes are compared whole unless it goes on from the pair one byte before, then only the byte that is new
    run = np.lexsort((y, x))
    x, y, k = x[run], y[run], k[run]
    near = data[x] == data[y]
    near &= data[x + window - 1] == data[y + window - 1]
    x, y, k = x[near], y[near], k[near]
    head = np.ones(len(x), bool)
    head[1:] = (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)
    ok = np.ones(len(x), bool)
    heads = np.flatnonzero(head)
    for lo in range(0, len(heads), 20_000):
        i = heads[lo : lo + 20_000]
        ok[i] = (data[x[i][:, None] + np.arange(window)] == data[y[i][:, None] + np.arange(window)]).all(1)
    # where a head differs, what goes on from it is compared whole as well
    of = np.cumsum(head) - 1
    again = np.flatnonzero(~head & ~ok[heads][of]) if len(heads) else heads
    for lo in range(0, len(again), 20_000):
        i = again[lo : lo + 20_000]
        ok[i] = (data[x[i][:, None] + np.arange(window)] == data[y[i][:, None] + np.arange(window)]).all(1)
    found[order[k[ok]]] = True
    found[order[k[ok] + 1]] = True
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


_RUNS = "array<struct<lo:int,hi:int>>"
_RUNS_T = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _sorted_kinds(kinds: DataFrame, window: int) -> DataFrame:
    """a, s, t, runs: the repeated windows of each kind of segment among those of the same anchor. kinds: a, s, t, c, n, q, bytes."""

    def finish(rows: list) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        start = np.cumsum([0, *(len(r[6]) for r in rows)])[:-1]
        count, place = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        anchor = np.repeat(np.unique([r[0] for r in rows], return_inverse=True)[1], count)
        group = anchor * (window + 1) + np.repeat(place, count) - within  # windows that have the same anchor at the same place
        found = np.split(repeated_windows(data, np.repeat(start, count) + within, group, window), np.cumsum(count)[:-1])
        runs = [[{"lo": 0, "hi": int(r[4]) - 1}] if r[3] > 1 else [{"lo": a, "hi": b} for a, b in _runs(f)] for r, f in zip(rows, found)]
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array(runs, _RUNS_T)], ["a", "s", "t", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size > (1 << 19) and r[0] != held[-1][0]:  # an anchor's rows stay together
                    yield finish(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield finish(held)

    n = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kinds.select(*_KIND, "bytes").repartition(n, "a").sortWithinPartitions("a", "s", "t")
    return dealt.mapInArrow(lean(run), f"a long, s long, t long, runs {_RUNS}")


def _grouped_kinds(kinds: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many kinds: each window is a row, grouped by its bytes with partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, s, t, c, n, _, raw in zip(*(x.to_pylist() for x in batch.columns)):
                same = [pa.array([x] * n, pa.int64()) for x in (a, s, t, c)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(n), pa.int32()), pa.array([raw[i : i + window] for i in range(n)], pa.binary())], ["a", "s", "t", "c", "i", "w"])

    windows = kinds.select(*_KIND, "bytes").mapInArrow(lean(run), "a long, s long, t long, c long, i int, w binary")
    twice = windows.groupBy("a", "w").agg(F.sum("c").alias("times")).where("times > 1").select("a", "w")
    found = windows.join(twice, ["a", "w"]).groupBy("a", "s", "t").agg(F.collect_set("i").alias("at"))
    return found.select("a", "s", "t", F.transform("at", lambda i: F.struct(i.alias("lo"), i.alias("hi"))).alias("runs"))


_KIND = ("a", "s", "t", "c", "n", "q")


def _fetched(rows: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """kinds with the bytes of each, from one row that has it. kinds: a, s, t, c and the row's id, h, lo, n, q."""
    names = (*_KIND, "lo")
    holders = cut(kinds.groupBy("id", "h").agg(F.collect_list(F.struct(*names)).alias("want")), "holders")
    keys = holders.select(F.col("id").alias("k_id"), F.col("h").alias("k_h"))
    texts = rows.join(sized(keys, 48), rows.id.eqNullSafe(keys.k_id) & (rows.h == keys.k_h), "left_semi")
    texts = texts.join(holders.withColumnsRenamed({"id": "k_id", "h": "k_h"}), F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                out: list = []
                for text, want in zip(batch.column(0).slice(k, 64), batch.column(1).slice(k, 64)):
                    raw = (text.as_py() or "").encode()
                    out += [(*(w[x] for x in _KIND), raw[w["lo"] : w["lo"] + w["n"] - 1 + window]) for w in want.as_py()]
                columns = list(zip(*out))
                kinds_ = [pa.array(x, y) for x, y in zip(columns, [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()])]
                yield pa.RecordBatch.from_arrays(kinds_, [*_KIND, "bytes"])

    # a repeated row fetches its segments once more: one of each kind is enough
    return texts.dropDuplicates(["id", "h"]).select("text", "want").mapInArrow(lean(fetch), "a long, s long, t long, c long, n int, q int, bytes binary")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most_kinds: int = MOST_KINDS) -> DataFrame:
    """id, h (hash of the text), spans: the maximal byte ranges [lo, hi) that repeated windows cover, of texts that have any."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    again = cut(anchors(rows.select("text"), window, gram).groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a"), "anchors")
    found = cut(segments(rows, window, gram).join(sized(again, 16), "a"), "segments")
    # anchors of several kinds of segments
    differ = F.greatest(*(F.when(F.min(x) != F.max(x), 1).otherwise(0) for x in ("s", "t"))).alias("differ")
    several = cut(found.groupBy("a").agg(differ).where("differ = 1").select("a"), "several")
    n_several = several.count()
    mixed = found.join(sized(several, 16, n_several), "a")
    kinds = mixed.groupBy("a", "s", "t").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "h", "lo", "n", "q")).alias("r"))
    kinds = cut(kinds.select("a", "s", "t", "c", "r.*"), "kinds")
    fetched = _fetched(rows, kinds, window)
    many = kinds.groupBy("a").count().where(F.col("count") > most_kinds).select("a")
    n_many = many.count()
    results = _sorted_kinds(fetched.join(sized(many, 16, n_many), "a", "left_anti") if n_many else fetched, window)
    if n_many:
        fetched = cut(fetched.join(sized(many, 16, n_many), "a", "left_semi"), "many")
        results = results.unionByName(_grouped_kinds(fetched, window))
    part = mixed.join(results, ["a", "s", "t"]).select("id", "h", F.explode("runs").alias("run"), "lo")
    part = part.select("id", "h", (F.col("lo") + F.col("run.lo")).alias("lo"), (F.col("lo") + F.col("run.hi") + window).alias("hi"))
    whole = found.join(sized(several, 16, n_several), "a", "left_anti").select("id", "h", "lo", (F.col("lo") + F.col("n") - 1 + window).alias("hi"))
    spans = whole.unionByName(part).groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(2):
                lo, hi = (spans.values.field(k).to_numpy() for k in (0, 1))
                reach = np.maximum.accumulate(hi)
                first = np.concatenate([[True], lo[1:] > reach[:-1]])
                last = np.concatenate([first[1:], [True]])
                out.append([{"lo": int(x), "hi": int(y)} for x, y in zip(lo[first], reach[last])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _RUNS_T)], ["id", "h", "spans"])

    return spans.mapInArrow(lean(merge), f"id long, h long, spans {_RUNS}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the bytes that stay (binary), and the byte ranges removed (null: none)."""
    own_id, own_h, spans_, kept_ = fresh(docs, "id", "h", "spans", "kept")
    spans = cut(repeats(docs, id_col, text_col, window), "spans").withColumnsRenamed({"id": own_id, "h": own_h, "spans": spans_})
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_h))
    size = spans.agg(F.coalesce(F.sum(64 + 8 * F.size(spans_)), F.lit(0)).alias("bytes")).first()["bytes"]
    joined = docs.join(sized(spans, 1, size), same, "left").drop(own_id, own_h)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # what stands between the removed spans, cut out of the bytes
    starts = F.concat(F.array(F.lit(0)), F.col(f"{spans_}.hi"))
    ends = F.concat(F.col(f"{spans_}.lo"), F.array(F.octet_length(raw)))
    pieces = F.zip_with(starts, ends, lambda a, b: F.hex(F.substring(raw, a + 1, b - a)))
    return joined.withColumn(kept_, F.when(F.col(spans_).isNull(), raw).otherwise(F.unhex(F.array_join(pieces, "")))), kept_, spans_


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed, kept, spans = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    sizes = F.transform(spans, lambda x: x["hi"] - x["lo"])
    return removed.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.coalesce(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size(F.when(F.col(spans).isNotNull(), F.col(spans))), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
