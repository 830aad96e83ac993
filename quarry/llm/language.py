"""Language identification: multinomial naive Bayes over hashed character n-grams.

The n-gram counts of the learning rows are summed per language by Spark; the log-probability
matrix (buckets x languages, a fixed size per language) is broadcast; texts are scored in
sparse batches with numpy. Character n-grams of 1 to 3 code points are taken from the lower-cased letters
of the text, every run of other characters counting as one space.

Defined cases: a text that is null or has no letter is `und` with score 0; where nothing was
learned every text is `und`; equal scores go to the language that sorts first; rows whose
language is null are not learned from; repeated rows count each; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnp
from .session import documents

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
#: Pseudo-count of every bucket.
ALPHA = 0.5
#: The score is the posterior at this many n-grams at most, as n-grams of a text aren't independent.
SHARPNESS = 60


@functools.cache
def letters() -> np.ndarray:
    """Of every code point its lower case if it is a letter, else a space."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(ch := chr(c))[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, their rows (not sorted), and which rows have a letter."""
    texts = column.cast(pa.large_string()).fill_null("")
    lengths = pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("\n".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    points = letters()[points]
    row = np.repeat(np.arange(len(texts)), lengths + 1)[: len(points)]
    space = points == 32
    keep = ~space
    keep[:-1] |= ~space[1:]  # of a run of spaces the last, which stands before a letter
    keep[1:] |= ~space[:-1] & (row[1:] == row[:-1])  # and one after a word
    both = keep & space
    both[1:] &= ~(both[:-1] & space[:-1] & space[1:])
    points, row = points[~space | both].astype(np.uint64), row[~space | both]
    has = np.zeros(len(texts), bool)
    has[row[points != 32]] = True
    out, rows = [], []
    for n in SIZES:
        if len(points) < n:
            continue
        h = np.zeros(len(points) - n + 1, np.uint64)
        for k in range(n):
            h += points[k : len(points) - n + 1 + k] * np.uint64(pow(textnp.R, k + n, 1 << 64))
        same = row[: len(h)] == row[n - 1 :]
        out.append((textnp.mix(h[same]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
        rows.append(row[: len(h)][same])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(out), np.concatenate(rows), has


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages (sorted), log-probabilities [bucket, language] and log-priors.

    Each task sums counts per language; Spark adds them by (language, bucket). The driver gets
    BUCKETS counts per language at most.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in textnp.slices(batch):
                codes = part.column(0).dictionary_encode()
                b, row, has = ngrams(part.column(1))
                of = codes.indices.to_numpy()
                for k, lang in enumerate(codes.dictionary.to_pylist()):
                    own = total.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    own[:BUCKETS] += np.bincount(b[of[row] == k], minlength=BUCKETS)
                    own[BUCKETS] += int((has & (of == k)).sum())  # the last one counts texts
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(c[at])], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    table = np.zeros((BUCKETS + 1, len(names)))
    if names:
        place = {x: k for k, x in enumerate(names)}
        table[got.column("bucket").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    smooth = table[:BUCKETS] + ALPHA
    prior = table[BUCKETS] + 1
    return names, np.log(smooth / smooth.sum(0)).astype(np.float32), np.log(prior / prior.sum()) if names else prior


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, lang_pred and score of every row."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    names, table, prior = model
    shared = docs.sparkSession.sparkContext.broadcast((names, table, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, prior = shared.value
        labels = np.array([*names, "und"], object)
        for batch in batches:
            for part in textnp.slices(batch, "__text", 2 << 20):
                b, row, has = ngrams(part.column(len(keep)))
                n = part.num_rows
                if names:
                    sums = np.stack([np.bincount(row, table[b, k], n) for k in range(len(names))], 1)
                    grams = np.bincount(row, minlength=n)
                    power = np.minimum(1, SHARPNESS / np.maximum(grams, 1))
                    sums = (sums + prior) * power[:, None]
                    best = sums.argmax(1)
                    odds = np.exp(sums - sums.max(1, keepdims=True))
                    score = np.where(has, 1 / odds.sum(1), 0.0)
                    best = np.where(has, best, len(names))
                else:
                    best, score = np.zeros(n, int), np.zeros(n)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(labels[best], pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    kept = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, f"{kept}lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out().alias("held_out"))
    return identify(docs, learn(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])
