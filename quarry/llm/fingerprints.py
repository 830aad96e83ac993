"""Document fingerprints: a threshold-scaled sketch of word shingles.

Of every text the hashes of its five-word shingles that fall below a fraction of the hash range are
retained. The fraction is fixed, but doubled for a short text until LEAST hashes are retained, or all. Sketches are
compared and merged below the smaller of their limits, which they tell themselves: so the sketch of a union follows
from the sketches, and short texts are compared with each other by all that they have. The containment of a short text
in a very long one can be told from their sketches where hashes of the short one lie below the long one's limit.

Defined cases: a null text counts as empty; an empty text (or one of white space only) has the
empty sketch, whose likeness is 1 to another empty one and 0 to any other; equal texts have
equal sketches; repeated rows are kept, each with its own result row; null ids sort first;
columns other than the id and the text are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnp
from .session import documents

#: The fraction of the hash range below which hashes are retained.
FRACTION = 1 / 8
SHINGLE_WORDS = 5
#: Least hashes of a sketch, unless the text has fewer.
LEAST = 16


def _levels(fraction: float) -> list[np.uint64]:
    """The limits that a sketch may have, from the fraction doubled up to the whole range."""
    out = []
    while fraction < 1:
        out.append(np.uint64(int(fraction * 2**64) - 1))
        fraction *= 2
    return [*out, np.uint64(2**64 - 1)]


def limit(sketch: np.ndarray, fraction: float = FRACTION) -> np.uint64:
    """The limit below which a sorted sketch holds all hashes: the first with LEAST of them, as told by the sketch itself."""
    levels = _levels(fraction)
    return next((x for x in levels if np.searchsorted(sketch, x, "right") >= LEAST), levels[-1])


def below(sketch: np.ndarray, most: np.uint64) -> np.ndarray:
    return sketch[: np.searchsorted(sketch, most, "right")]


def sketches(column: pa.Array, fraction: float = FRACTION, n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sketch of every text: sorted distinct uint64 hashes."""
    h, row = textnp.word_shingles(column, n)
    keep = h <= _levels(fraction)[0]
    low_h, low_row = h[keep], row[keep]
    order = np.lexsort((low_h, low_row))
    low_h, low_row = low_h[order], low_row[order]
    fresh = np.ones(len(low_h), bool)
    fresh[1:] = (low_h[1:] != low_h[:-1]) | (low_row[1:] != low_row[:-1])
    low_h, low_row = low_h[fresh], low_row[fresh]
    ends = np.searchsorted(low_row, np.arange(len(column) + 1))
    starts = np.searchsorted(row, np.arange(len(column) + 1))
    out = []
    for i in range(len(column)):
        own = low_h[ends[i] : ends[i + 1]]
        if len(own) < LEAST:
            own = np.unique(h[starts[i] : starts[i + 1]])
            own = below(own, limit(own, fraction))
        out.append(own)
    return out


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    most = min(limit(a, fraction), limit(b, fraction))
    both = np.union1d(below(a, most), below(b, most))
    return below(both, limit(both, fraction))


def likeness(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Estimated containment of the smaller shingle set in the larger, 0 to 1, from the hashes below the limits of both.

    0 also where the smaller has none there: of k shingles that is so for (7/8)^k of texts at a limit of 1/8.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    most = min(limit(a, fraction), limit(b, fraction))
    a, b = below(a, most), below(b, most)
    return len(np.intersect1d(a, b, assume_unique=True)) / max(1, min(len(a), len(b)))


def as_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """id, sketch (array of 64-bit hashes as longs), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnp.slices(batch):
                got = sketches(part.column(1), fraction)
                row = np.repeat(np.arange(len(got)), [len(x) for x in got])
                flat = np.concatenate([*got, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), textnp.list_array(flat, row, len(got), pa.int64())], ["id", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, sketch array<bigint>")


def _bucketed(rows: DataFrame, n: int) -> tuple[DataFrame, list]:
    """Rows with the number of the id range that they are in, of about n ranges of equal size; the first row of each."""
    bounds = sorted({int(x) for x in rows.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)} if n > 1 else ())
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    if bounds:
        at = F.aggregate(
            F.lit(steps),
            F.lit(0),
            lambda acc, s: F.when(
                (acc + s <= len(bounds)) & (F.get(F.lit(bounds), acc + s - 1) <= F.col("id")), acc + s
            ).otherwise(acc),
        )
    else:
        at = F.lit(0)
    rows = rows.withColumn("bucket", at.cast("int"))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("id", "hash")).alias("first")).collect()  # one row a range
    return rows, sorted((r["bucket"], r["first"]["id"], r["first"]["hash"]) for r in firsts)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, halo, id, hash, text) dealt by id range and sorted, each range followed by a halo: the next range's first row.

    The text is moved once. The driver gets one id per range; the number of ranges is the
    session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 14)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows, firsts = _bucketed(rows, n)
    halos = spark.createDataFrame(
        [(f[1], f[2], firsts[k - 1][0]) for k, f in enumerate(firsts)], "first_id long, first_hash long, before int"
    )
    same = rows.id.eqNullSafe(halos.first_id) & (rows.hash == halos.first_hash)
    rows = rows.join(F.broadcast(halos), same, "left")
    both = F.when(
        F.col("before").isNotNull(), F.array(F.struct("bucket", F.lit(0).alias("halo")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("halo")))
    ).otherwise(F.array(F.struct("bucket", F.lit(0).alias("halo"))))
    dealt = rows.select(F.explode(both).alias("at"), "id", "hash", "text").select("at.bucket", "at.halo", "id", "hash", "text")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "halo", "id", "hash")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness, see the columns below."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_retained long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, whose next one is still to come
        for batch in batches:
            for part in textnp.slices(batch):
                rows = list(zip(*(part.column(k).to_pylist() for k in (0, 1, 2, 4)), sketches(part.column(4), fraction)))
                if last is not None:
                    rows.insert(0, last)
                last = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]
                if not pairs:
                    continue
                cut = [len(a[3]) // 4 for a, _ in pairs]
                edited = [a[3][: len(a[3]) - n] + b[3][:n] for n, (a, b) in zip(cut, pairs)]
                found = sketches(pa.array(edited, pa.large_string()), fraction)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                        pa.array([as_text(a[4]) for a, _ in pairs]),
                        pa.array([as_text(x) for x in found]),
                        pa.array([likeness(a[4], x, fraction) for (a, _), x in zip(pairs, found)], pa.float64()),
                        pa.array([likeness(a[4], b[4], fraction) for a, b in pairs], pa.float64()),
                        pa.array([len(a[4]) for a, _ in pairs], pa.int64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_retained"],
                )

    return with_next(docs, id_col, text_col).mapInArrow(run, schema)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(documents(spark, sf_dir))
