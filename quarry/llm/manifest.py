"""Merkle manifest of a dataset: a digest per row, a tree per group of rows, a witness per row, and their verification.

Incremental witnesses: leaves are appended in order, and subtrees that still wait for a right sibling are open. Each
leaf has the part of its witness that lies inside its open subtree; when a sibling is complete, the witnesses of both
sides grow by the other's root. Leaves are dealt out in aligned blocks of 2**LEVELS, one small task group each; the
roots of blocks are then appended like leaves, block of blocks by block, until one node remains, and the witnesses of a block extend
those of all its leaves. Groups' roots are once more appended, in order of the group, and give the root of all.

The tree: every two consecutive nodes become the digest of both, a last single one the digest of itself, until one
remains; a lone leaf is its own root. A digest is the lower-case hexadecimal SHA-256 of its inputs' hexadecimal texts.

Defined cases: a null field counts as `-`, others as their number of UTF-8 bytes, a colon and the value, so null
and empty differ; a null group is a group of its own, the first; rows without id come first in their group; rows of one
id are ordered by their leaf; equal rows are leaves each; other columns are ignored; an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .session import cut, documents, sized

#: Levels of a block: it has 2**LEVELS leaves, whatever the input.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:boolean,digest:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class OpenTree:
    """Leaves are appended; `open` holds the roots of complete subtrees that wait for their right sibling, highest first."""

    def __init__(self) -> None:
        self.open: list[tuple[int, int, str]] = []  # height, first leaf, root
        self.witnesses: list[list[dict]] = []

    def append(self, leaf: str) -> None:
        self.open.append((0, len(self.witnesses), leaf))
        self.witnesses.append([])
        while self._paired():
            self._join()

    def _paired(self) -> bool:
        return len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]

    def _join(self) -> None:
        """The last two subtrees, of one height, become one: the witnesses of each grow by the other's root."""
        height, middle, right = self.open.pop()
        _, first, left = self.open.pop()
        for w in self.witnesses[first:middle]:
            w.append({"left": False, "digest": right})
        for w in self.witnesses[middle:]:
            w.append({"left": True, "digest": left})
        self.open.append((height + 1, first, digest(left, right)))

    def close(self, height: int = 0) -> str:
        """The root, once nothing is appended any more: the last subtree goes up by itself until it has a sibling, or the height."""
        while len(self.open) > 1 or self.open[0][0] < height:
            if self._paired():
                self._join()
                continue
            own, first, root = self.open.pop()
            for w in self.witnesses[first:]:
                w.append({"left": False, "digest": None})
            self.open.append((own + 1, first, digest(root)))
        return self.open[0][2]


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields: `-` for null, else bytes, colon, value."""
    text = [f.cast("string") for f in fields]
    told = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def folded(start: Column | str, siblings: Column | str) -> Column:
    """The root that a leaf and the siblings on its way come to."""
    start = F.col(start) if isinstance(start, str) else start
    return F.aggregate(
        siblings, start,
        lambda acc, s: F.sha2(F.when(s["digest"].isNull(), acc).when(s["left"], F.concat(s["digest"], acc)).otherwise(F.concat(acc, s["digest"])).cast("binary"), 256),
    )


def proof(siblings: Column | str) -> Column:
    """The digest of all siblings on the way."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: s["digest"]), "").cast("binary"), 256)


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (group, ...) with `pos`, their place in their group by the order, and `n`, the group's number of nodes.

    Rows are dealt out in ranges of group and order; a range's rows are numbered by themselves, and the counts of the
    ranges before it (a row per range and group) are added. Equal rows may lie in several ranges, as `tie` tells them apart.
    """
    ranges = nodes.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    ranges = cut(ranges, "nodes").repartitionByRange("group", *order, "tie").withColumn("range", F.spark_partition_id())
    ranges = cut(ranges, "ranges")
    counts = ranges.groupBy("group", "range").agg(F.count(F.lit(1)).alias("n_range"))
    of = W.partitionBy("group")
    counts = counts.select(
        "group", "range", F.coalesce(F.sum("n_range").over(of.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n_range").over(of).alias("n")
    )
    counts = cut(counts, "counts")
    own = F.row_number().over(W.partitionBy("group", "range").orderBy(*order, "tie"))
    rows = ranges.withColumn("own", own).join(sized(counts, 200), ["group", "range"])
    return rows.withColumn("pos", F.col("before") + F.col("own") - 1).drop("range", "tie", "own", "before")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (group, pos, n, digest) -> group, pos, n, block, siblings inside the block, root of the block."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree = OpenTree()
        for x in table["digest"].to_pylist():
            tree.append(x)
        alone = table["n"][0].as_py() <= 1 << levels
        root = tree.close(0 if alone else levels)
        kind = pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.string())]))
        return table.select(["group", "pos", "n", "block"]).append_column("siblings", pa.array(tree.witnesses, kind)).append_column("root", pa.array([root] * len(table)))

    blocks = nodes.select("group", "pos", "n", F.shiftright("pos", levels).alias("block"), "digest")
    return blocks.groupBy("group", "block").applyInArrow(grow, f"group string, pos long, n long, block long, siblings {STEP}, root string")


def trees(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes (group, pos, n, digest) -> group, pos, siblings up to the group's root, root.

    Each round closes blocks and appends their roots in the next one; there are log(n) / levels rounds.
    """
    rounds = []
    while True:
        rounds.append(cut(_blocks(nodes, levels), "blocks"))
        roots = rounds[-1].where(F.col("pos") == F.shiftleft("block", levels)).where(F.col("n") > 1 << levels)
        if roots.isEmpty():
            break
        nodes = roots.select("group", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << levels)).alias("n"), F.col("root").alias("digest"))
    found = rounds.pop().select("group", "pos", "siblings", "root")
    while rounds:
        above = found.select("group", F.col("pos").alias("block"), F.col("siblings").alias("more"), F.col("root").alias("top"))
        joined = rounds.pop().join(sized(above, 4_000), ["group", "block"], "left")
        siblings = F.concat("siblings", F.coalesce("more", F.array().cast(STEP)))
        found = joined.select("group", "pos", siblings.alias("siblings"), F.coalesce("top", "root").alias("root"))
    return found


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """id, group_value, pos, leaf, siblings (from the leaf to the root of all), subroot, root, and what is carried (expressions over docs).

    The texts are read once, for the leaves; from there on only digests are moved.
    """
    key = F.col(f"`{group_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("="), key), F.lit("")).alias("group"),  # null first, then bytewise
        leaf(*(F.col(f"`{f}`") for f in fields)).alias("digest"), F.struct(F.lit(0).alias("none"), *(c.alias(n) for n, c in (carry or {}).items())).alias("carried"),
    )
    nodes = cut(_numbered(rows, ["id", "digest"]), "leaves")
    own = cut(trees(nodes.select("group", "pos", "n", "digest"), levels), "witnesses")
    subroots = own.where("pos = 0").select(F.col("group").alias("name"), F.lit("").alias("group"), F.col("root").alias("digest"))
    tops = cut(_numbered(subroots, ["name"]), "subroots")
    over = trees(tops.select("group", "pos", "n", "digest"), levels)
    over = tops.select("name", "pos").join(sized(over.drop("group"), 4_000), "pos").select(F.col("name").alias("group"), F.col("siblings").alias("more"), F.col("root").alias("all"))
    joined = nodes.join(own, ["group", "pos"]).join(sized(cut(over, "tops"), 4_000), "group")
    value = F.when(F.col("group") != "", F.substring("group", 2, 1 << 30))
    return joined.select(
        "id", value.alias("group_value"), "pos", F.col("digest").alias("leaf"), F.concat("siblings", "more").alias("siblings"), F.col("root").alias("subroot"), F.col("all").alias("root"),
        *(F.col(f"carried.`{n}`").alias(n) for n in carry or {}),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    shown = leaf(*(tampered if f == "n_chars" else F.col(f) for f in FIELDS))
    rows = manifest(docs, carry={"shown": shown}).withColumn("folded_root", folded("shown", "siblings"))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof("siblings").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
