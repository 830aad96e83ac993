"""Toxicity: nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index.

Learning takes at most MOST_EXAMPLES labelled rows (those of the smallest hash of their id). All words of a text
are in its vector and in its norm: a word weighs the logarithm of its count, its inverse document frequency over all
documents, and the square of its relevance frequency among the examples (log2(2 + toxic / other examples that have it), 1 for
words that no example has). Without that last factor the nearest texts are those of the same subject, whatever their label.
Words are told apart by cells, see `lexicon`.

Examples with the same vector are one entry with its counts. Entries stand in blocks; per word the index holds the blocks
that have it with the largest weight in each, so that blocks are scored in the order of their upper bounds until no
block left can reach the nearest entries found. The result is the exact one.

The score is the share of toxic examples among the nearest, weighted by cosine and drawn towards the
general share; a text without words gets the share of such texts among the examples.

Defined cases: a null or empty text is one without words; ties at the last neighbour are all
counted; without labelled rows every score is 0; labelled rows whose label is null, or whose id isn't among
the documents, teach nothing; an id that is labelled twice has its highest label; repeated rows
are each scored; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnp
from .language import held_out
from .lexicon import BUCKETS, Statistics, cells, counted, statistics
from .session import cut, documents

#: Labelled rows that are learned from.
MOST_EXAMPLES = 4096
NEIGHBOURS = 15
BLOCK = 64
#: Weight of the general share among the votes.
PRIOR = 0.1
TOXIC = 0.3

def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), and the place of the range of each."""
    size = hi - lo
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum()), np.repeat(np.arange(len(lo)), size)


class Index:
    """Block-max inverted index over the distinct example vectors, for one query at a time."""

    def __init__(self, known: Statistics, size: np.ndarray, term: np.ndarray, count: np.ndarray, n: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        """Of every entry: its number of cells, number of examples, of toxic ones, smallest id; the cells and counts of all one after the other."""
        has = size > 0
        self.share = float(y.sum() / n.sum()) if n.sum() else 0.0
        self.none = float((y[~has].sum() + PRIOR * self.share) / (n[~has].sum() + PRIOR))
        size, n, y, ids = (x[has] for x in (size, n, y, ids))
        entries = len(size)
        of = np.repeat(np.arange(entries), size)
        rate = (y / np.maximum(n, 1))[of]
        yes, no = (np.bincount(term, x, 1 << BUCKETS) for x in (rate, 1 - rate))
        self.scale = (known.idf() * np.log2(2 + yes / np.maximum(no, 1)) ** 2).astype(np.float32)
        weight = (1 + np.log(count)) * self.scale[term]
        weight /= np.sqrt(np.bincount(of, weight**2, entries))[of]
        # entries whose heaviest words are the same stand in one block, so that its bounds are tight
        heaviest = np.full(entries, -1)
        by_weight = np.lexsort((term, weight, of))
        heaviest[of[by_weight]] = term[by_weight]
        place = np.empty(entries, np.int64)
        by = np.lexsort((ids, heaviest, y * 2 < n))
        place[by] = np.arange(entries)
        self.n, self.y, self.id = n[by], y[by], ids[by]
        self.blocks = -(-entries // BLOCK)
        entry = place[of]
        order = np.lexsort((entry, term))
        term, self.entry, self.weight = term[order], entry[order].astype(np.int32), weight[order].astype(np.float32)
        # of every word the blocks that have it: block, largest weight, and where the block's postings begin
        block = self.entry // BLOCK
        head = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.block, self.most = block[head], np.maximum.reduceat(self.weight, head) if len(head) else weight
        self.begin, self.end = head, np.append(head[1:], len(term))[: len(head)]
        self.lists = np.searchsorted(term[head], np.arange((1 << BUCKETS) + 1)).astype(np.int32)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines of the k nearest examples (an entry counts as often as it has examples; ties at the end included).

        Blocks are scored in the order of their bounds, twice as many each time, until the next bound is below the last neighbour.
        """
        w = (1 + np.log(counts)) * self.scale[terms]
        w = w / np.sqrt((w * w).sum())
        at, of = _ranges(self.lists[terms], self.lists[terms + 1])
        x, block = w[of], self.block[at]
        bound = np.bincount(block, x * self.most[at], self.blocks)
        turn = np.argsort(-bound, kind="stable")
        turn = turn[: np.count_nonzero(bound)]
        entries, cosines, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        done, step = 0, 16
        while done < len(turn) and bound[turn[done]] >= least - 1e-9:
            chosen = np.zeros(self.blocks, bool)
            chosen[turn[done : done + step]] = True
            done, step = done + step, step * 2
            own = np.flatnonzero(chosen[block])
            post, which = _ranges(self.begin[at[own]], self.end[at[own]])
            cosine = np.bincount(self.entry[post], self.weight[post] * x[own][which], len(self.n))
            found = np.flatnonzero(cosine >= max(least - 1e-9, 1e-12))
            cosine = cosine[found]
            if len(found) > k:  # every entry is one example at least, so none beyond the k-th best of this turn can stay
                own = cosine >= np.partition(cosine, len(found) - k)[len(found) - k] - 1e-9
                found, cosine = found[own], cosine[own]
            entries, cosines = np.append(entries, found), np.append(cosines, cosine)
            order = np.lexsort((entries, -cosines))
            entries, cosines = entries[order], cosines[order]
            reach = np.flatnonzero(np.cumsum(self.n[entries]) >= k)
            if len(reach):
                least = cosines[reach[0]]
                keep = cosines >= least - 1e-9
                entries, cosines = entries[keep], cosines[keep]
        return entries, cosines

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        """Share of toxic votes, and the ids of up to three nearest examples."""
        if not len(terms):
            return self.none, []
        entries, cosines = self.nearest(terms, counts)
        if not len(entries):
            return self.share, []
        weight = cosines * self.n[entries]
        rate = self.y[entries] / self.n[entries]
        return float(((weight * rate).sum() + PRIOR * self.share) / (weight.sum() + PRIOR)), self.id[entries[:3]].tolist()


def _examples(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """id, text, y of a bounded number of labelled documents, one row per distinct text."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` small rows
    return rows.groupBy("text").agg(F.min("doc_id").alias("id"), F.max("y").alias("y"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_EXAMPLES) -> Index:
    """The index, from labelled rows (labels: doc_id and the label) and the frequencies of all docs."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnp.slices(batch):
                row, at, c = counted(*cells(part.column(0)))
                lists = [textnp.list_array(x, row, part.num_rows, pa.int64()) for x in (at, c)]
                yield pa.RecordBatch.from_arrays([*lists, part.column(1), part.column(2)], ["terms", "counts", "y", "id"])

    rows = cut(_examples(docs, labels, label, most), "examples").select("text", F.col("y").cast("long").alias("y"), F.col("id").cast("long").alias("id"))
    same = rows.mapInArrow(vectors, "terms array<bigint>, counts array<bigint>, y long, id long").groupBy("terms", "counts")
    got = same.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.min("id").alias("id")).toArrow().combine_chunks()  # at most `most`
    terms, counts, n, y, ids = (pa.concat_arrays(c.chunks) if c.chunks else pa.array([], c.type) for c in got.columns)
    size = pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    return Index(statistics(docs), size, *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms.flatten(), counts.flatten(), n, y, ids)))


def score(docs: DataFrame, index: Index, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, score and evidence (ids of nearest examples) of every row."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in textnp.slices(batch, "__text"):
                row, at, c = counted(*cells(part.column(len(keep))))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                out = [index.score(at[a:b], c[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([x for x, _ in out], pa.float64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], [*keep, "score", "evidence"])

    kept = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, f"{kept}score double, evidence array<bigint>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out().alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score(docs, learn(docs.select("doc_id", "text"), labels), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")
