"""Words of texts as cells, and their statistics over all documents.

A word is a run of letters, digits and non-ASCII bytes, lower-cased (A-Z). Words are told apart by 2 ** BUCKETS cells of
their hash, so that what is known of all words of a corpus has a fixed size: words that share a cell have their
frequencies added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textnp
from .session import lean

#: Cells, as a power of two, in which document frequencies are counted.
BUCKETS = 21
#: BM25's saturation and length normalisation.
K1, B = 1.2, 0.75


def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the words of all texts in order, and their rows."""
    data, offsets = textnp.flat(column)
    data = textnp.LOWER[data]
    start, end, row = textnp.words(data, offsets, textnp.ALNUM)
    return (textnp.short_hashes(data, start, end) >> np.uint64(64 - BUCKETS)).astype(np.int64), row


def counted(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, cell and count of each distinct cell of each text, sorted by them."""
    key, n = np.unique(row << BUCKETS | word, return_counts=True)
    return key >> BUCKETS, key & (1 << BUCKETS) - 1, n


class Statistics:
    """Number and mean length of all documents and, of each cell, the number of documents that have a word in it."""

    def __init__(self, n: int, mean: float, df: np.ndarray) -> None:
        self.n, self.mean, self.df = n, mean, df

    def idf(self) -> np.ndarray:
        """Of each cell, above 0 however many documents have it; one that none has weighs like one that one has."""
        return np.log((self.n + 1) / np.maximum(self.df, 1))

    def weights(self, word: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """BM25 weights; idf stays above 0 however many documents have the word."""
        df = self.df[word]
        idf = np.log(1 + np.maximum(self.n - df + 0.5, 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(self.mean, 1)))


def statistics(rows: DataFrame) -> Statistics:
    """Of all rows' `text`: sums per cell in every task, added by Spark; the driver gets 2 ** BUCKETS counts at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, length = np.zeros(1 << BUCKETS, np.int64), 0, 0
        for batch in batches:
            for part in textnp.slices(batch):
                word, row = cells(part.column(0))
                total += np.bincount(counted(word, row)[1], minlength=len(total))
                n, length = n + part.num_rows, length + len(word)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(total[at], [n, length]))], ["word", "n"])

    found = rows.select("text").mapInArrow(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = (found.column(k).to_numpy() for k in (0, 1))
    df = np.zeros(1 << BUCKETS, np.int64)
    df[word[word >= 0]] = n[word >= 0]
    total, length = (int(n[word == k].sum()) for k in (-1, -2))
    return Statistics(total, length / max(total, 1), df)
