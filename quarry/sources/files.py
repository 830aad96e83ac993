"""Markdown files, bounded reads of them, and conversation logs, as DataFrames."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def glob_regex(pattern: str) -> str:
    """`**` stands for anything, `*` for anything without a slash, `?` for one character."""
    out = re.sub(r"\*\*|\*|\?|[^*?]+", lambda m: {"**": ".*", "*": "[^/]*", "?": "."}.get(m.group(), re.escape(m.group())), pattern)
    return f"^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    """A pattern without a slash also matches the file's name; its first `/**/` also stands for one slash."""
    hit = path.rlike(glob_regex(pattern))
    if "/" not in pattern:
        hit |= F.regexp_extract(path, r"[^/]*$", 0).rlike(glob_regex(pattern))
    if "/**/" in pattern:
        hit |= path.rlike(glob_regex(pattern.replace("/**/", "/", 1)))
    return hit


def any_glob(path: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit |= glob_match(path, p)
    return hit


def selected(files: DataFrame, include: list[str], exclude: list[str], path: str = "path") -> DataFrame:
    """The files that some include pattern matches and no exclude pattern."""
    return files.where(any_glob(F.col(path), include) & ~any_glob(F.col(path), exclude))


def normal_path(absolute: Column, root: str, home: str | None = None) -> Column:
    """Below home: home/...; below the root: relative; else absolute. Home is looked at first."""
    home = home if home is not None else os.path.expanduser("~")
    below = lambda top: absolute.startswith(top.rstrip("/") + "/")
    rest = lambda top: F.substring(absolute, len(top.rstrip("/")) + 2, 1 << 20)
    return F.when(below(home), F.concat(F.lit("home/"), rest(home))).when(below(root), rest(root)).otherwise(absolute)


def listed(spark: SparkSession, root: str, include: list[str], exclude: list[str], home: str = "/nonexistent") -> DataFrame:
    """location, path, size_bytes, modified of the Markdown files below a root, each once; no file is opened.

    Spark lists the folders; patterns apply to paths relative to the root.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    absolute = F.regexp_replace("path", "^file:/*", "/")
    rows = read.select(F.col("path").alias("location"), absolute.alias("absolute"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    top = os.path.abspath(root)
    relative = F.substring("absolute", len(top.rstrip("/")) + 2, 1 << 20)
    rows = selected(rows.withColumn("relative", relative), include, exclude, "relative").dropDuplicates(["absolute"])
    return rows.select("location", normal_path(F.col("absolute"), top, home).alias("path"), "size_bytes", "modified")


def contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """path, text, file_hash, size_bytes, modified of listed files (location, path, size_bytes, modified): these are opened, and no others.

    Their places go through the driver, as those of all files do that Spark reads.
    """
    places = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r["location"]) for r in files.select("location").collect()]  # names, not patterns
    if not places:
        return spark.createDataFrame([], "path string, text string, file_hash string, size_bytes long, modified timestamp")
    read = spark.read.format("binaryFile").load(places).select(F.col("path").alias("location"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return read.join(files, "location").select("path", "text", F.sha2("text", 256).alias("file_hash"), "size_bytes", "modified")


def scan(spark: SparkSession, root: str, include: list[str], exclude: list[str], home: str = "/nonexistent") -> DataFrame:
    """path, text, file_hash, size_bytes, modified of the Markdown files below a root, each once."""
    return contents(spark, listed(spark, root, include, exclude, home))


def line_range(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path, from_line, n_lines) -> path, from_line, n_lines, text; lines counted from 1 and clamped to the file."""
    lines = F.split("text", r"\r?\n")
    first = F.least(F.greatest(F.coalesce("from_line", F.lit(1)), F.lit(1)), F.greatest(F.size(lines), F.lit(1)))
    n = F.least(F.greatest(F.coalesce("n_lines", F.lit(20)), F.lit(1)), F.size(lines) - first + 1)
    return files.join(wanted, "path").select("path", first.alias("from_line"), n.alias("n_lines"), F.array_join(F.slice(lines, first, n), "\n").alias("text"))


def workspace_path(path: str, root: str) -> str:
    """The absolute path, which must not lead out of the root."""
    full = os.path.realpath(os.path.join(root, path))
    if full != os.path.realpath(root) and not full.startswith(os.path.realpath(root) + os.sep):
        raise ValueError(f"{path} lies outside of the workspace")
    return full


def session_logs(spark: SparkSession, path: str) -> DataFrame:
    """conv_id (file), turn (line, from 1), role, content of JSON-lines logs; content that is no string is its JSON; malformed lines are skipped.

    Lines are numbered within the blocks that Spark splits files into, and go on from the lines of the blocks before, so no file is one task.
    """
    block = ["conv_id", "at"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("conv_id"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), "value")
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = lines.withColumn("line", F.row_number().over(Window.partitionBy(*block).orderBy("k"))).join(sizes, block)
    told = numbered.select("conv_id", (F.col("before") + F.col("line")).alias("turn"), F.from_json("value", "role string, content string").alias("m"))
    return told.where(F.col("m.role").isNotNull() | F.col("m.content").isNotNull()).select("conv_id", "turn", "m.role", "m.content")


def transcripts(messages: DataFrame, least_chars: int = 100) -> DataFrame:
    """conv_id, text, n_turns of conversations (conv_id, turn, role, text) long enough to save: lines `role: text` by turn."""
    line = F.concat_ws(": ", F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit("")))
    said = messages.select("conv_id", "turn", line.alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return said.groupBy("conv_id").agg(joined.alias("text"), F.count(F.lit(1)).alias("n_turns")).where(F.length("text") >= least_chars)


def sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", least_chars: int = 100) -> DataFrame:
    """conv_id, began, ended, text, n_turns: the transcripts of messages (conv_id, ts, turn, role, text) in sessions, which a gap longer than `gap` ends.

    Of a stream, a session comes once the watermark (`late` behind the latest message) has passed its end, and its state goes with it; messages
    later than that aren't taken. Messages without a time are in no session. A transcript is one row, as it is one text.
    """
    seen = messages.withWatermark("ts", late) if messages.isStreaming else messages
    line = F.concat_ws(": ", F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit("")))
    said = seen.where("ts IS NOT NULL").select("conv_id", "ts", F.struct("ts", "turn", line.alias("line")).alias("said"))
    every = F.sort_array(F.collect_list("said"))
    rows = said.groupBy("conv_id", F.session_window("ts", gap).alias("session")).agg(every.alias("lines"), F.count(F.lit(1)).alias("n_turns"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    rows = rows.select("conv_id", F.col("session.start").alias("began"), F.element_at("lines", -1)["ts"].alias("ended"), text.alias("text"), "n_turns")
    return rows.where(F.length("text") >= least_chars)


#: Lines between those whose place is kept.
EVERY = 256


def line_places(spark: SparkSession, location: str, every: int = EVERY) -> DataFrame:
    """line (from 1), at: the byte at which every so many-th line of a file begins, and `lines`, the number of all of them; of an empty file none.

    A byte feed ends a line, so a file that ends with one has an empty line after it. Lines are measured within the blocks that Spark splits a
    file into and moved by the blocks before, so no file is one task. A byte order mark, which the reader leaves out, is told by the file's size.
    """
    read = spark.read.option("lineSep", "\n").text(location)
    rows = read.select(F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("k"), (F.octet_length("value") + 1).cast("long").alias("n"))
    own = Window.partitionBy("block").orderBy("k")
    placed = rows.withColumn("i", F.row_number().over(own)).withColumn("to", F.sum("n").over(own))
    before, whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # over a row per block
    blocks = rows.groupBy("block").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("b"), F.max("size").alias("of"))
    told = {f"{x}_before": F.coalesce(F.sum(x).over(before), F.lit(0)) for x in "cb"} | {f"{x}_all": F.sum(x).over(whole) for x in "cb"}
    blocks = blocks.withColumns(told).drop("c", "b")
    mark = F.when(F.col("b_all") <= F.col("of") - 2, 3).otherwise(0)
    line, at = F.col("c_before") + F.col("i"), F.col("b_before") + F.col("to") - F.col("n") + mark
    lines = F.col("c_all") + F.when(F.col("b_all") + mark == F.col("of"), 1).otherwise(0)
    found = placed.join(F.broadcast(blocks), "block").select(line.alias("line"), F.when(line == 1, 0).otherwise(at).alias("at"), lines.alias("lines"))
    return found.where((F.col("line") - 1) % every == 0)


def file_status(spark: SparkSession, location: str) -> tuple[int, int]:
    """Bytes of a file, and the millisecond of its last change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return status.getLen(), status.getModificationTime()


def read_bytes(spark: SparkSession, location: str, at: int, n: int) -> bytes:
    """n bytes of a file from a place on; what lies before and behind isn't read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(at)
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def line_slice(spark: SparkSession, location: str, places: DataFrame, from_line: int | None, n_lines: int | None) -> tuple[int, int, str]:
    """from_line, n_lines and text of a range as `line_range` clamps it, read between the two known places around it."""
    first, n = max(1, from_line or 1), max(1, 20 if n_lines is None else n_lines)
    start = F.max(F.when(F.col("line") <= first, F.struct("line", "at"))).alias("start")
    around = places.agg(start, F.min(F.when(F.col("line") >= first + n, F.col("at"))).alias("end"), F.max("lines").alias("lines")).first()
    line, at = around["start"] or (1, 0)
    lines = around["lines"] or 1
    end = file_status(spark, location)[0] if around["end"] is None else around["end"]
    first = min(first, lines)
    n = min(n, lines - first + 1)
    text = re.split(r"\r?\n", read_bytes(spark, location, at, end - at).decode("utf-8", "replace"))
    return first, n, "\n".join(text[first - line : first - line + n])
