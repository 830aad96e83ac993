"""N-gram Jaccard join: a MinHash LSH forest, followed by exact verification.

Every distinct text gets TREES signatures of DEPTH minimum hashes of its word shingles, of 16 bits each. Each tree is a
prefix trie of its signatures, as sorted bytes: texts meet in a node if they agree in its prefix. The forest is first read
at full depth. The similarities met there tell how many of the links each shorter prefix would miss (a link of similarity
s is missed by all trees with a probability of (1 - s ** depth) ** TREES), and matched prefixes are shortened to the longest
one that reaches the target recall; then only nodes count that hold texts of several groups.

Texts that meet are compared within the node before they are grouped, by what their signatures say of their similarity: only those
within six standard errors of the threshold are joined, so texts that merely share boilerplate aren't. Within a node a text
is compared with those of other groups only, so a node of near copies costs one comparison a text. Nodes yield stars of groups,
never pairs. A node of any size is compared like that: a large one is dealt out as pairs of blocks of bounded size. The texts of a group are then compared exactly, in blocks of bounded size by products of incidence matrices; a
block yields counts of links and a spanning forest, never pairs. Very large groups are dealt out as pairs of blocks.

Defined cases: a null text counts as empty; texts without words have no links; a text of one to four words has one
shingle, of all its words; copies of a text are in one class, and aren't counted as links;
null ids are allowed (a class that has no other id gets a null); repeated rows are copies;
other columns, whatever their names, are ignored here and kept by `one_of_each`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnp
from .session import cut, documents, fresh, lean, sized

THRESHOLD = 0.8
SHINGLE_WORDS = 5
TREES = 32
#: Depth of the tries, and the share of the links that must be expected to meet.
DEPTH, RECALL = 8, 1 - 1e-6
#: Bytes of a text's sketch, one of every other minimum hash, by which texts in a node are compared.
SKETCH = TREES * DEPTH // 2
#: Rows of a node that are compared in one piece; a larger node is dealt out as pairs of blocks of half as many.
NODE_ROWS = 4096
#: Texts and shingles of a block.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 400_000


def loose(threshold: float) -> int:
    """Equal bytes of two sketches that links have, but for six standard errors."""
    return math.floor(SKETCH * threshold - 6 * math.sqrt(SKETCH * threshold * (1 - threshold)))


def prefix_length(met: np.ndarray, threshold: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that is expected to let that share of all links meet.

    met: how often texts met at full depth whose sketches have k equal bytes, by k. A pair of similarity s meets trees * s ** depth
    times there. Where nothing near the threshold was met, links at the threshold itself are allowed for.
    """
    s = np.clip(np.arange(len(met)) / (len(met) - 1), threshold, 1)
    links = np.where(np.arange(len(met)) >= threshold * (len(met) - 1), met, 0) / (trees * s**depth)
    links = np.append(links, 1 + 0.001 * links.sum())
    s = np.append(s, threshold)
    for d in range(depth, 1, -1):
        if (links * (1 - s**d) ** trees).sum() <= (1 - recall) * links.sum():
            return d
    return 1


def _seeds(n: int) -> np.ndarray:
    return textnp.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(textnp.R)) | np.uint64(1)


def signatures(rows: DataFrame) -> DataFrame:
    """id, node, size (distinct shingles), sig (TREES * DEPTH minimum hashes of 2 bytes) and sketch (both null for a text without words). rows: id, node, text."""
    seeds = _seeds(TREES * DEPTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnp.slices(batch, most=1 << 20):
                h, row = textnp.word_shingles(part.column(2), SHINGLE_WORDS)
                n = part.num_rows
                size, sig, sketch = np.zeros(n, np.int64), np.full(n, None, object), np.full(n, None, object)
                if len(h):
                    order = np.lexsort((h, row))
                    new = np.ones(len(h), bool)
                    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
                    h, row = h[order][new], row[order][new]
                    size = np.bincount(row, minlength=n)
                    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    least = np.empty((len(edge), len(seeds)), ">u2")
                    for k, seed in enumerate(seeds):
                        least[:, k] = textnp.mix(np.minimum.reduceat(h * seed, edge)) & np.uint64(0xFFFF)
                    raw = least.tobytes()
                    sig[row[edge]] = [raw[k : k + 2 * len(seeds)] for k in range(0, len(raw), 2 * len(seeds))]
                    low = least[:, ::2].astype(np.uint8).tobytes()  # the low byte of every other minimum
                    sketch[row[edge]] = [low[k : k + SKETCH] for k in range(0, len(low), SKETCH)]
                columns = [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(sig.tolist(), pa.binary()), pa.array(sketch.tolist(), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "node", "size", "sig", "sketch"])

    return rows.mapInArrow(lean(run), "id long, node binary, size long, sig binary, sketch binary")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root: of every node of the edges (node, to) the smallest node that it is connected to.

    Rounds of two steps: neighbours take over the smallest root around them, then roots are followed
    one step (so that long chains shorten by half). Each round is a table in the shared folder; the driver
    gets one count a round.
    """
    both = cut(edges.select("node", "to").where(F.col("node") != F.col("to")).unionByName(edges.select(F.col("to").alias("node"), F.col("node").alias("to"))).where(F.col("node") != F.col("to")).distinct(), f"{name}-edges")
    roots = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("root")), name)
    while True:
        near = both.join(roots.select(F.col("node").alias("to"), "root"), "to").groupBy("node").agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        jump = step.join(roots.select(F.col("node").alias("next"), F.col("root").alias("beyond")), "next", "left")
        new = cut(jump.select("node", F.least("next", F.coalesce("beyond", "next")).alias("root"), (F.least("next", F.coalesce("beyond", "next")) != F.col("was")).alias("moved")), name)
        roots = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return roots


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """left x right: whether the shingle sets are as similar. Products of incidence matrices, some columns at a time."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(np.concatenate(sets), kind="stable")
    values = np.concatenate(sets)[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(fresh) - 1
    row = row[order]
    often = np.bincount(column)[column] > 1
    column, row = column[often], row[often]
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
    both = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + step, step))
    for lo, hi in zip(edges[:-1], edges[1:]):
        m = np.zeros((len(sets), step), np.float32)
        m[row[lo:hi], column[lo:hi] % step] = 1
        both += m[left] @ m[right].T
    union = size[left][:, None] + size[right][None, :] - both
    return (both > 0) & (both >= threshold * union - 1e-6)


def _forest(adjacent: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Of every text the first one of its connected texts in the block."""
    root = np.arange(n)
    while True:
        # a text takes over the smallest root of its neighbours
        new = root.copy()
        r = np.where(adjacent, root[right][None, :], n).min(1, initial=n)
        np.minimum.at(new, left, r)
        c = np.where(adjacent, new[left][:, None], n).min(0, initial=n)
        np.minimum.at(new, right, c)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """node, links (in this block), to (a connected node of the block). blocks: block, part (0: both sides, 1: left, 2: right), node, shingles; dealt by block and sorted."""

    def finish(rows: list) -> pa.RecordBatch:
        seen: dict = {}
        for r in rows:  # a repeated row's text came more than once
            seen.setdefault((r[1], r[2]), r)
        rows = sorted(seen.values(), key=lambda r: r[2])
        part = np.array([r[1] for r in rows])
        sets = [np.frombuffer(r[3], np.int64) for r in rows]
        left, right = np.flatnonzero(part != 2), np.flatnonzero(part != 1)
        adjacent = _links(sets, left, right, threshold)
        if (part == 0).all():
            np.fill_diagonal(adjacent, False)
        links = np.zeros(len(rows), np.int64)
        links[left] += adjacent.sum(1)
        if (part != 0).any():
            links[right] += adjacent.sum(0)
        root = _forest(adjacent, left, right, len(rows))
        return pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.binary()), pa.array(links), pa.array([rows[k][2] for k in root], pa.binary())], ["node", "links", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and r[0] != held[-1][0]:
                    yield finish(held)
                    held = []
                held.append(r)
        if held:
            yield finish(held)

    return blocks.mapInArrow(lean(run), "node binary, links long, to binary")


def _met_in_nodes(members: DataFrame, least: int) -> DataFrame:
    """label, to: groups of texts that met in a node and are near by their sketches, to the smallest one there; and met, n: how often
    texts of so many equal bytes met (label is null; between groups, so of near copies each counts about once). members: block, label, sketch; sorted by them."""

    def join(rows: list, met: np.ndarray) -> list[tuple[bytes, bytes]]:
        names = sorted({r[1] for r in rows})
        place = {x: k for k, x in enumerate(names)}
        label = np.array([place[r[1]] for r in rows])
        sketch = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        root = np.arange(len(names))
        for k in range(len(rows) - 1):
            other = k + 1 + np.flatnonzero(root[label[k + 1 :]] != root[label[k]])
            if len(other):
                equal = (sketch[other] == sketch[k]).sum(1)
                np.add.at(met, equal, 1)
                near = np.unique(root[label[other[equal >= least]]])
                if len(near):
                    near = np.append(near, root[label[k]])
                    root[np.isin(root, near)] = near.min()
        return [(names[k], names[r]) for k, r in enumerate(root.tolist()) if r != k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        met = np.zeros(SKETCH + 1, np.int64)
        found: set = set()

        def out(pairs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary()), pa.array([None] * len(pairs), pa.int32()), pa.array([None] * len(pairs), pa.int64())], ["label", "to", "met", "n"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and r[0] != held[-1][0]:
                    found.update(join(held, met))
                    held = []
                    if len(found) > 50_000:
                        yield out(list(found))
                        found.clear()
                held.append(r)
        if held:
            found.update(join(held, met))
        yield out(list(found))
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(at), pa.binary()), pa.array([None] * len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(met[at])], ["label", "to", "met", "n"])

    return members.mapInArrow(lean(run), "label binary, to binary, met int, n long")


def _blocks(members: DataFrame) -> DataFrame:
    """block, label, sketch: the rows of every node, of a large one as pairs of blocks, so that any two of its rows stand together in one. members: key, node, label, sketch, n."""
    parts = F.when(F.col("n") <= NODE_ROWS, 1).otherwise(F.ceil(F.col("n") * 2 / NODE_ROWS)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("mine"))
    pairs = F.transform(others, lambda k: F.xxhash64("key", F.least("mine", k), F.greatest("mine", k)))
    dealt = members.withColumn("parts", parts).withColumn("mine", mine)
    return dealt.select(F.explode(F.when(F.col("parts") == 1, F.array("key")).otherwise(pairs)).alias("block"), "label", "sketch")


def meetings(labelled: DataFrame, depth: int, threshold: float) -> tuple[DataFrame, np.ndarray]:
    """Edges (node, to) between groups of texts that meet at that depth and are near, and how often texts met, by equal bytes of their sketches. labelled: node, label, sig, sketch."""
    n = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = F.array(*(F.xxhash64(F.lit(t), F.substring("sig", 2 * DEPTH * t + 1, 2 * depth)) for t in range(TREES)))
    in_tries = labelled.select(F.explode(keys).alias("key"), F.xxhash64("label").alias("l")).groupBy("key").agg(F.min("l").alias("a"), F.max("l").alias("b"), F.count(F.lit(1)).alias("n"))
    tries = cut(in_tries.where("a < b").select("key", "n"), "tries")
    n_tries = tries.count()
    members = labelled.select(F.explode(keys).alias("key"), "node", "label", "sketch").join(sized(tries, 24, n_tries), "key")
    found = cut(_met_in_nodes(_blocks(members).repartition(n, "block").sortWithinPartitions("block", "label"), loose(threshold)), "met")
    edges = found.where("label is not null").select(F.col("label").alias("node"), "to")
    met = np.zeros(SKETCH + 1, np.int64)
    for r in found.where("met is not null").groupBy("met").agg(F.sum("n").alias("n")).collect():  # at most SKETCH + 1 rows
        met[r["met"]] = r["n"]
    return edges.distinct(), met


def candidates(texts: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, int]:
    """node, root: groups of texts that may be linked; and the length that prefixes were shortened to. texts: node, sig, sketch."""
    texts = texts.where("sig is not null")
    edges, met = meetings(texts.select("node", F.col("node").alias("label"), "sig", "sketch"), DEPTH, threshold)
    groups = components(edges, "groups")
    depth = prefix_length(met, threshold)
    if depth < DEPTH:
        known = groups.select(F.col("node").alias("k_node"), "root")
        labelled = texts.join(sized(known, 64), F.col("node") == F.col("k_node"), "left").select("node", F.coalesce("root", "node").alias("label"), "sig", "sketch")
        further = components(meetings(labelled, depth, threshold)[0], "groups")
        beyond = further.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        joined = groups.join(sized(beyond, 64), "root", "left").select("node", F.coalesce("beyond", "root").alias("root"))
        groups = cut(joined.unionByName(further.join(groups.select("node"), "node", "left_anti")), "groups")
    return groups, depth


def shingle_sets(rows: DataFrame) -> DataFrame:
    """id, node, shingles (sorted distinct 64-bit hashes as bytes). rows: id, node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnp.slices(batch):
                h, row = textnp.word_shingles(part.column(2), SHINGLE_WORDS)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                sets = [np.unique(h[a:b]).astype("<u8").tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], ["id", "node", "shingles"])

    return rows.mapInArrow(lean(run), "id long, node binary, shingles binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """members (id, node) with a row per row of docs, and texts (node, class_id, links, copies, keeper) with a row per distinct text.

    class_id: the smallest id of all texts connected by links; keeper: whether the text holds it
    (of the texts that hold it, the smallest by hash).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("node"), F.col(text_col).alias("text"))
    signed = cut(signatures(rows), "signed")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = cut(signed.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.min("sig").alias("sig"), F.min("sketch").alias("sketch")), "texts")
    groups, _ = candidates(texts, threshold)
    texts = texts.drop("sig", "sketch")
    # groups in blocks: a bounded number of texts and shingles each
    sizes = groups.join(texts, "node").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    wanted = cut(groups.join(sized(cut(sizes.select("root", parts.alias("parts")), "sizes"), 48), "root").select(F.col("node").alias("w_node"), "root", "parts"), "wanted")
    small = sized(wanted, 64)
    holders = rows.join(small, F.col("node") == F.col("w_node"))
    holders = shingle_sets(holders.select("id", "node", "text")).dropDuplicates(["node"])
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = holders.join(small, F.col("node") == F.col("w_node")).select("root", "parts", mine.alias("mine"), "node", "shingles")
    both = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct(
            F.least("mine", k).alias("x"), F.greatest("mine", k).alias("y"),
            F.when(k == F.col("mine"), 0).when(F.col("mine") < k, 1).otherwise(2).alias("part"),
        ),
    )
    blocks = placed.select(F.explode(both).alias("b"), "root", "node", "shingles")
    blocks = blocks.select(F.struct("root", "b.x", "b.y").alias("key"), F.col("b.part").alias("part"), "node", "shingles")
    blocks = blocks.withColumn("block", F.concat(F.col("key.root"), F.encode(F.concat_ws(":", F.lit(""), "key.x", "key.y"), "utf-8")))
    blocks = blocks.select("block", "part", "node", "shingles").repartition(n, "block").sortWithinPartitions("block", "part", "node")
    checked = cut(verified(blocks, threshold), "checked")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(checked.where("node != to").select("node", "to"), "linked")
    named = texts.join(links, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # the smallest id of a class, and one text that has it
    least = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "node")).alias("least"))
    named = named.join(sized(cut(least, "least"), 80), "root").select(
        "node", F.col("least.id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies", (F.col("least.node") == F.col("node")).alias("keeper"), F.col("id").alias("first_id")
    )
    return signed.select("id", "node"), named


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs of which one stays per class: the one with the smallest id; of repeated rows one."""
    _, texts = classes(docs, id_col, text_col, threshold)
    own_node, first = fresh(docs, "node", "first")
    keep = cut(texts.where("keeper").select(F.col("node").alias(own_node), F.col("first_id").alias(first)), "keepers")
    node = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    same = (node == F.col(own_node)) & F.col(id_col).cast("long").eqNullSafe(F.col(first))
    kept = docs.join(sized(keep, 64), same).drop(first)
    return kept.dropDuplicates([own_node]).drop(own_node)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, texts = classes(documents(spark, sf_dir))
    return members.join(texts, "node").select(F.col("id").alias("doc_id"), "class_id", F.col("links").alias("n_links"), F.col("copies").alias("n_copies"))
