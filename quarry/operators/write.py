"""Writes: manifests, replacement by file, direct saves with deduplication, relations, accesses and savings.

Tables are plain Parquet, so a mutation is a new version of a table: what stays is kept by an
anti join, what is new is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from quarry.functions.text import lookup_path, nfkd, parent_path, slug, token_count
from quarry.tables import cut, sized

DUPLICATE_SECONDS = 60


def manifest_diff(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, change (new, changed, touched, same, missing) of files (path, file_hash, modified) against the manifest's.

    touched: another modification time with the same hash.
    """
    old = manifest.select("path", F.col("file_hash").alias("old_hash"), F.col("modified").alias("old_modified"))
    both = old.join(files.select("path", "file_hash", "modified"), "path", "full_outer")
    change = (
        F.when(F.col("old_hash").isNull(), "new").when(F.col("file_hash").isNull(), "missing").when(F.col("old_hash") != F.col("file_hash"), "changed")
        .when(F.col("old_modified") != F.col("modified"), "touched").otherwise("same")
    )
    return both.select("path", change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def replace_by_file(chunks: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks with those of the changed files (path) replaced by the new ones; agents' chunks stay."""
    gone = F.broadcast(changed.select(F.col("path").alias("source_file")).distinct()) if changed.isLocal() else changed.select(F.col("path").alias("source_file")).distinct()
    stay = chunks.where("source <> 'file'").unionByName(chunks.where("source = 'file'").join(gone, "source_file", "left_anti").select(*chunks.columns))
    return stay.unionByName(new.select(*chunks.columns))


def delete_missing(chunks: DataFrame, scanned: DataFrame) -> DataFrame:
    """Chunks without those of files that weren't scanned."""
    there = scanned.select(F.col("path").alias("source_file")).distinct()
    return chunks.where("source <> 'file'").unionByName(chunks.where("source = 'file'").join(there, "source_file", "left_semi").select(*chunks.columns))


def accepted_saves(saves: DataFrame, seconds: int = DUPLICATE_SECONDS, earlier: DataFrame | None = None) -> DataFrame:
    """saves (save_id, ts, content) with `accepted`: content that was accepted less than so many seconds before isn't.

    earlier (ts, hash): what was accepted before these saves.

    The time counts from the last accepted save, not from the last one: a fold over each content's times in order.
    A save so many seconds after the one before it is always accepted, so a content's times are cut there into pieces that
    are dealt out. The fold holds the last accepted time only; nothing is gathered.
    """
    hashed = saves.withColumn("hash", F.sha2(F.trim("content"), 256))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("hash").orderBy("at", F.desc("given"), "save_id")
    times = hashed.select("hash", at.alias("at"), "save_id", F.lit(False).alias("given"))
    if earlier is not None:
        times = times.unionByName(earlier.select("hash", at.alias("at"), F.lit(None).cast(saves.schema["save_id"].dataType).alias("save_id"), F.lit(True).alias("given")))
    fresh = F.coalesce((F.col("at") - F.lag("at").over(w) >= seconds * 1_000_000).cast("int"), F.lit(1))
    times = times.withColumn("fresh", fresh).withColumn("piece", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    times = times.select("hash", "piece", "at", "given", "save_id").repartition("hash", "piece").sortWithinPartitions("hash", "piece", "at", F.desc("given"), "save_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = last = None
        for batch in batches:
            keep = []
            for k, (hash_, piece, time, given) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if own != (hash_, piece):
                    own, last = (hash_, piece), None
                if given:
                    last = time
                elif last is None or time - last >= seconds * 1_000_000:
                    last = time
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(keep, pa.int64()))], ["save_id"])

    kept = times.mapInArrow(fold, f"save_id {dict(saves.dtypes)['save_id']}").withColumn("accepted", F.lit(True))
    return hashed.join(kept, "save_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def saved(chunks: DataFrame, saves: DataFrame, replace: bool = False, earlier: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What the accepted saves (save_id, ts, content, path, heading) come to: new chunks, one each, next in order on its path, and the chunks that go.

    replace: each save takes the place of all that is on its path, whatever was saved before; of several on a path the last one stays.
    Contents are kept in compatibility decomposition, as files are, so that a search finds accented words.
    """
    path = F.when(F.trim("path") != "", lookup_path("path")).otherwise(F.concat(F.lit("agent_writes.session."), slug(F.coalesce("heading", F.lit("Session snapshot")))))
    told = plain_saves(saves).where(F.trim("content") != "")
    if replace:
        new = told.withColumn("lookup_path", path).withColumn("back", F.row_number().over(W.partitionBy("lookup_path").orderBy(F.desc("ts"), F.desc("save_id")))).where("back = 1")
    else:
        new = accepted_saves(told, earlier=earlier).where("accepted").withColumn("lookup_path", path)
    new = cut(new, "saves")
    there = chunks.join(sized(new.select("lookup_path").distinct(), 200, new.count()), "lookup_path", "left_semi")
    last = (there.limit(0) if replace else there).groupBy("lookup_path").agg(F.max("chunk_order").alias("last"))
    order = F.row_number().over(W.partitionBy("lookup_path").orderBy("ts", "save_id"))
    new = new.withColumn("n", order).join(last, "lookup_path", "left").withColumn("chunk_order", (F.coalesce("last", F.lit(-1)) + F.col("n")).cast("int"))
    rows = new.select(
        F.xxhash64(F.lit("agent"), F.lit(""), "lookup_path", "chunk_order").alias("chunk_id"), "lookup_path", parent_path("lookup_path").alias("parent_path"), "chunk_order",
        F.lit("agent").alias("source"), F.trim("content").alias("content"), token_count(F.trim("content")).alias("token_count"), F.lit("").alias("source_file"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
    )
    return rows.select(*chunks.columns), there.select(*chunks.columns) if replace else None


def plain_saves(saves: DataFrame) -> DataFrame:
    """saves with their contents in the form in which they are kept and compared."""
    return saves.withColumn("content", nfkd("content"))


def save(chunks: DataFrame, saves: DataFrame, replace: bool = False, earlier: DataFrame | None = None) -> DataFrame:
    """The chunks after these saves."""
    new, gone = saved(chunks, saves, replace, earlier)
    if gone is not None:
        chunks = chunks.join(gone.select("lookup_path").distinct(), "lookup_path", "left_anti").select(*chunks.columns)
    return chunks.unionByName(new)


def relate(edges: DataFrame) -> DataFrame:
    """subject, predicate, object with paths and predicate as they are kept."""
    return edges.select(lookup_path("subject").alias("subject"), slug("predicate").alias("predicate"), lookup_path("object").alias("object"))


def run_counters(diff: DataFrame) -> DataFrame:
    """files_scanned, files_changed (new or changed) and files_missing of a manifest's diff, in one row."""
    n = lambda *kinds: F.coalesce(F.sum(F.col("change").isin(*kinds).cast("long")), F.lit(0))
    scanned = F.coalesce(F.sum((F.col("change") != "missing").cast("long")), F.lit(0))
    return diff.agg(scanned.alias("files_scanned"), n("new", "changed").alias("files_changed"), n("missing").alias("files_missing"))


def access_stats(log: DataFrame) -> DataFrame:
    """access_count and last_accessed per chunk of a log (chunk_id, ts)."""
    return log.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_accessed"))
