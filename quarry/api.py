"""The engine as one object: build and refresh an index, search, look up, fetch, save, relate, savings.

Results are DataFrames; `envelope` wraps a small one for callers that want a plain dictionary.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import re
import threading
import time
import uuid
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.functions import markdown, text as T
from quarry.operators import index as I, retrieve as R, segments as G, write as W
from quarry.operators.logs import Log
from quarry.sources import files as S
from quarry.sources.config import Settings
from quarry.tables import cut, shared_folder, sized

API_VERSION = "1"
RUN = "started_at timestamp, ended_at timestamp, scope string, files_scanned long, files_changed long, chunks_added long, chunks_deleted long, status string"
NO_RELATIONS = "subject string, predicate string, object string"
QUERY = "query_id long, query string, limit int, max_tokens int, path_prefix string"


class EngineError(ValueError):
    """code: INVALID_CONTENT, INVALID_RELATION, INVALID_QUERY or INVALID_OPERATION."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class Engine:
    """One index and its logs below a folder: `path`, or one of its own in the shared folder.

    The index is kept in segments and versions (operators/segments.py): every change is a new version, and what was read before keeps
    its rows. An index of another engine may be given: its segments are shared, what changes is this engine's own.
    """

    #: Milliseconds that a save which doesn't wait stays in the queue, for others to join it.
    DEBOUNCE_MS = 500
    #: Bytes of a file that is read whole for a range of its lines.
    WHOLE_BYTES = 1 << 20

    def __init__(self, spark: SparkSession, settings: Settings, index: I.Index | None = None, manifest: DataFrame | None = None, record: bool = True, path: str | None = None) -> None:
        self.spark, self.settings, self.record = spark, settings, record  # record: searches, lookups and fetches count as accesses of what they return
        self.store = G.Store(spark, path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
        self._index, self.manifest = index, manifest
        self._queue: list[tuple[DataFrame, bool]] = []
        self._timer: threading.Timer | None = None
        self._lock = threading.RLock()
        last = lambda rows: rows.groupBy("hash").agg(F.max("ts").alias("ts"))
        logs = {
            "accesses": ("chunk_id long, n long, ts timestamp", lambda rows: rows.groupBy("chunk_id").agg(F.sum("n").alias("n"), F.max("ts").alias("ts"))),
            "saved": ("ts timestamp, hash string", last), "relations": (NO_RELATIONS, lambda rows: rows), "index_runs": (RUN, lambda rows: rows),
            "savings": ("tokens_saved long", lambda rows: rows.agg(F.sum("tokens_saved").alias("tokens_saved"))),
        }
        self.kept = {name: Log(spark, f"{self.store.root}/logs/{name}", schema, fold) for name, (schema, fold) in logs.items()}

    @classmethod
    def open(cls, spark: SparkSession, settings: Settings, path: str | None = None) -> "Engine":
        """The engine that lies at the path (by default the settings' index path), with its last version and its logs; an empty one if there is none."""
        own = cls(spark, settings, path=path or settings.db_path)
        return own.reopen()

    def reopen(self) -> "Engine":
        """This engine with the last version that anyone has written; an index without chunks where there is none."""
        version = self.store.latest()
        return self._at(version or G.Version(0, ()))

    @property
    def logs(self) -> dict[str, DataFrame]:
        """The rows of the logs that have any."""
        return {name: log.rows() for name, log in self.kept.items() if log}

    @property
    def index(self) -> I.Index | None:
        """The index, with all saves in it."""
        self.flush()
        return self._index

    @property
    def version(self) -> G.Version | None:
        """The version that this engine reads."""
        return self._index.version if self._index else None

    def _access(self) -> DataFrame:
        if not self.kept["accesses"] and self._index is not None:
            return self._index.access
        return self.kept["accesses"].rows().groupBy("chunk_id").agg(F.sum("n").alias("access_count"), F.max("ts").alias("last_accessed"))

    def _relations(self) -> DataFrame:
        given = getattr(self, "_given_relations", None)
        if given is None:
            given = self._given_relations = self._index.relations if self._index is not None else self.spark.createDataFrame([], NO_RELATIONS)
        return given.unionByName(self.kept["relations"].rows()) if self.kept["relations"] else given

    def _at(self, version: G.Version) -> "Engine":
        self._index = replace(self.store.index(version, self._access(), self._relations()), version=version)
        self.manifest = self.store.files(version)
        return self

    def _base(self) -> G.Version:
        """The version that the next change is made of: this folder's last one, else that of the index that was given."""
        mine = self.store.latest()
        if mine is None and self._index is not None and self._index.version is None:  # an index from elsewhere: its chunks are the first version
            self._at(self.store.change(None, self._index.chunks))
        return mine or self.version or G.Version(0, ())

    def _change(self, change, batch: tuple[str, int] | None = None) -> None:
        """change(index of the base) -> (new chunks, dead chunks, files) or None; made anew if another writer comes first. Afterwards segments of one size are merged."""
        for tries in range(3):
            base = self._base()
            found = change(self.store.index(base, self._access(), self._relations()), self.store.files(base))
            if found is None:
                self._at(base)
                return
            try:
                version = self.store.change(base, *found, batch)
                break
            except G.Conflict:
                if tries == 2:
                    raise
        try:
            version = self.store.compacted(version)
        except G.Conflict:  # another writer goes on from here, and merges
            version = self.store.latest()
        self._at(version)

    def _audit(self, began: dt.datetime, scope: str, scanned: int, changed: int, added: int, deleted: int) -> None:
        self.kept["index_runs"].append(self.spark.createDataFrame([(began, dt.datetime.now(), scope, scanned, changed, added, deleted, "ok")], RUN))

    def build(self, files: DataFrame | None = None) -> "Engine":
        """A full index of the settings' roots, or of given files (path, text)."""
        began = dt.datetime.now()
        files = cut(self._hashed(S.contents(self.spark, self._listed()) if files is None else files), "files")
        base = replace(self._base(), segments=())
        fresh = cut(markdown.chunks(files), "fresh")
        self._at(self.store.change(base, fresh, None, self._noted(files)))
        n = self.manifest.count()
        self._audit(began, "full", n, n, fresh.count(), 0)
        return self

    def _listed(self) -> DataFrame:
        """The files of all roots, each once, unopened; a root that isn't there has none."""
        files = self.spark.createDataFrame([], "location string, path string, size_bytes long, modified timestamp")
        for root in self.settings.roots:
            try:
                files = files.unionByName(S.listed(self.spark, root, self.settings.include_globs, self.settings.exclude_globs))
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return files.dropDuplicates(["path"])

    @staticmethod
    def _hashed(files: DataFrame) -> DataFrame:
        """files with file_hash, size_bytes and modified, where they came as (path, text) only."""
        more = {"file_hash": F.sha2("text", 256), "size_bytes": F.octet_length("text").cast("long"), "modified": F.lit(None).cast("timestamp")}
        return files.withColumns({c: v for c, v in more.items() if c not in files.columns})

    @staticmethod
    def _noted(files: DataFrame, gone: bool = False) -> DataFrame:
        return files.select("path", "file_hash", "size_bytes", "modified", F.lit(gone).alias("gone"))

    def refresh(self, files: DataFrame | None = None, batch: tuple[str, int] | None = None) -> "Engine":
        """Only new and changed files (path, text, and file_hash and modified if known; else those of the roots) are parsed; chunks of missing ones go.

        Of the roots' files only those are opened whose size or time differs from what the manifest says. A new version is
        written only if something changed. batch: a stream's name and the number of its batch; one that has written before isn't run again.
        """
        if batch is not None and batch[1] <= self._base().batches.get(batch[0], -1):
            self._at(self._base())
            return self
        began, counts = dt.datetime.now(), {}
        given = None if files is None else cut(self._hashed(files), "given")

        def change(index: I.Index, manifest: DataFrame):
            if given is None:
                listed = cut(self._listed(), "listed")
                known = manifest.select("path", F.col("size_bytes").alias("s"), F.col("modified").alias("m"))
                suspects = listed.join(known, "path", "left").where(~(F.col("s").eqNullSafe(F.col("size_bytes")) & F.col("m").eqNullSafe(F.col("modified")))).select(*listed.columns)
                there, opened = listed.select("path"), cut(S.contents(self.spark, cut(suspects, "suspects")), "opened")
            else:
                there, opened = given.select("path"), given
            # files that weren't opened are as the manifest has them
            seen = manifest.join(opened.select("path"), "path", "left_anti").join(there, "path", "left_semi").unionByName(opened.select(*manifest.columns))
            diff = cut(W.manifest_diff(manifest, seen), "diff")
            counts.update(W.run_counters(diff).first().asDict())
            counts["touched"] = diff.where("change = 'touched'").count()
            counts["opened"] = opened.count()
            if not counts["files_changed"] + counts["files_missing"] + counts["touched"]:
                counts.update(added=0, deleted=0)
                return None
            parsed = cut(markdown.chunks(opened.join(diff.where(F.col("change").isin("new", "changed")), "path", "left_semi")), "fresh")
            gone = diff.where(F.col("change").isin("changed", "missing")).select(F.col("path").alias("source_file"))
            dead = cut(index.chunks.where("source = 'file'").join(sized(gone, 200), "source_file", "left_semi").select(*parsed.columns), "gone")
            counts.update(added=parsed.count(), deleted=dead.count())
            missing = manifest.join(diff.where("change = 'missing'"), "path", "left_semi")
            noted = self._noted(opened.join(diff.where(F.col("change").isin("new", "changed", "touched")), "path", "left_semi")).unionByName(self._noted(missing, True))
            return parsed, dead, noted

        self.flush()
        before = self._index
        self._change(change, batch)
        if not counts["files_changed"] + counts["files_missing"] + counts["touched"] and before is not None and before.version == self.version:
            self._index = before
        self._audit(began, "changed", counts["files_scanned"], counts["files_changed"], counts["added"], counts["deleted"])
        return self

    def _seen(self, rows: DataFrame, now: Column | None) -> DataFrame:
        """The rows, few and written, whose chunks count as accessed."""
        rows = cut(rows, "answer")
        if self.record and not rows.isEmpty():
            self.record_access(rows.select("chunk_id", (F.current_timestamp() if now is None else now).alias("ts")))
        return rows

    def _one(self, query: str, limit: int, prefix: str | None) -> DataFrame:
        if not query or not query.strip():
            raise EngineError("INVALID_QUERY", "a query needs words")
        return self.spark.createDataFrame([(1, query, limit, self.settings.max_tokens_per_query, prefix)], QUERY)

    def search(self, query: str, limit: int = 5, path_prefix: str | None = None, now: Column | None = None, fallback=None) -> DataFrame:
        """Reranked hits of one query, with their places and reasons; `fallback(query)` answers where there are none."""
        hits = self.search_many(self._one(query, max(limit, 8), path_prefix), now)
        best = self._seen(R.located(R.rerank(hits, limit), self.index.chunks), now)
        return fallback(query) if fallback is not None and best.isEmpty() else best

    def search_many(self, queries: DataFrame, now: Column | None = None) -> DataFrame:
        return R.text_search(self.index, queries, F.current_timestamp() if now is None else now, chars=self.settings.snippet_chars)

    def trace(self, query: str, limit: int = 8, path_prefix: str | None = None, now: Column | None = None) -> DataFrame:
        """ord, stage and hits of the stages that a search of this query runs and that find something; nothing counts as accessed."""
        found = R.traced_search(self.index, self._one(query, limit, path_prefix), F.current_timestamp() if now is None else now)
        return found[1].drop("query_id").orderBy("ord")

    def lookup(self, query: str, limit: int = 5, path_prefix: str | None = None, now: Column | None = None) -> tuple[str, DataFrame]:
        """("path", chunks) for what looks like a path, else ("search", hits)."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+", query.strip()):
            return "search", self.search(query, limit, path_prefix, now)
        wanted = self.spark.createDataFrame([(1, query.strip().lower(), limit, self.settings.max_tokens_per_query)], "query_id long, path string, limit int, max_tokens int")
        return "path", self._seen(R.path_lookup(self.index, wanted, F.current_timestamp() if now is None else now, self.settings.snippet_chars), now)

    def path_root(self) -> DataFrame:
        return R.path_root(self.index.paths)

    def path_children(self, parent: str | None, cursor: str | None = None, limit: int = 100) -> DataFrame:
        return R.path_children(self.index.paths, self.spark.createDataFrame([(1, parent, cursor, limit)], "query_id long, parent string, cursor string, limit int"))

    def fetch(self, chunk_id: int, now: Column | None = None) -> DataFrame:
        return self._seen(R.chunk_fetch(self.index.chunks, self.spark.createDataFrame([(chunk_id,)], "chunk_id long")), now)

    def get(self, path: str, from_line: int | None = None, n_lines: int | None = None, root: str = ".") -> DataFrame:
        """A range of lines of a file inside the root.

        Of a file of over WHOLE_BYTES the places of its lines are found once for each of its states and kept beside the index; then only the bytes around the range are read.
        """
        try:
            full = S.workspace_path(path, root)
        except ValueError as e:
            raise EngineError("INVALID_OPERATION", str(e)) from e
        location, form = f"file://{full}", "path string, from_line int, n_lines int"
        size, modified = S.file_status(self.spark, location)
        if size > self.WHOLE_BYTES:
            found = S.line_slice(self.spark, location, self._line_places(location, size, modified), from_line, n_lines)
            return self.spark.createDataFrame([(path, *found)], f"{form}, text string")
        file = self.spark.read.text(location, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
        return S.line_range(file, self.spark.createDataFrame([(path, from_line, n_lines)], form))

    def _line_places(self, location: str, size: int, modified: int) -> DataFrame:
        state = hashlib.sha256(f"{location}:{size}:{modified}".encode()).hexdigest()
        kept = f"{self.store.root}/lines/{state}"
        if not self.store.exists(f"{kept}/_SUCCESS"):
            S.line_places(self.spark, location).write.mode("overwrite").parquet(kept)
        return self.spark.read.schema("line long, at long, lines long").parquet(kept)

    def prompt_context(self, query: str, now: Column | None = None, trigger: str | None = None) -> str:
        """The context of a prompt; none for a short one, or one that no user gave."""
        if trigger not in (None, "", "user") or len((query or "").strip()) < 4:
            return ""
        row = R.prompt_context(self.search(query, 6, now=now).withColumn("rank", F.col("new_rank"))).first()
        return row["context"] if row else ""

    def save(self, saves: DataFrame, replace: bool = False, wait: bool = True) -> "Engine":
        """saves: save_id, ts, content, path, heading. Saves without content are refused; what was saved within 60 seconds before isn't saved again.

        replace: what is on a save's path goes. wait: the save is in the index when this returns; else it joins the others of the
        next DEBOUNCE_MS in one change, and is there at the next look at the index at the latest.
        """
        saves = cut(W.plain_saves(saves), "given")
        if not saves.where(F.coalesce(F.trim("content"), F.lit("")) == "").isEmpty():
            raise EngineError("INVALID_CONTENT", "a save needs content")
        with self._lock:
            self._queue.append((saves, replace))
            if self._timer:
                self._timer.cancel()
                self._timer = None
            if not wait:
                self._timer = threading.Timer(self.DEBOUNCE_MS / 1000, self.flush)
                self._timer.daemon = True
                self._timer.start()
        if wait:
            self.flush()
        return self

    def flush(self) -> None:
        """All queued saves go into the index, those of one kind that follow each other as one change."""
        with self._lock:
            if self._queue and self._timer:
                self._timer.cancel()
                self._timer = None
            while self._queue:
                replace_, together = self._queue[0][1], []
                while self._queue and self._queue[0][1] == replace_:
                    together.append(self._queue.pop(0)[0])
                try:
                    self._take(functools.reduce(DataFrame.unionByName, together), replace_)
                except Exception:  # they stay queued, so that the next look at the index tries again
                    self._queue[:0] = [(saves, replace_) for saves in together]
                    raise

    def _take(self, saves: DataFrame, replace_: bool) -> None:
        hashes = saves.select(F.sha2(F.trim("content"), 256).alias("hash")).distinct()
        earlier = cut(self.kept["saved"].rows().join(hashes, "hash", "left_semi").select("ts", "hash"), "earlier")
        self._change(lambda index, _: (*W.saved(index.chunks, saves, replace_, earlier), None))
        taken = W.accepted_saves(saves, earlier=earlier)
        self.kept["saved"].append((taken if replace_ else taken.where("accepted")).select("ts", "hash"))

    def relate(self, subject: str, predicate: str, obj: str) -> "Engine":
        if not all(x and x.strip() for x in (subject, predicate, obj)):
            raise EngineError("INVALID_RELATION", "a relation needs subject, predicate and object")
        self._relations()
        self.kept["relations"].append(W.relate(self.spark.createDataFrame([(subject, predicate, obj)], NO_RELATIONS)))
        self._index = replace(self.index, relations=self._relations())
        return self

    def record_access(self, log: DataFrame) -> "Engine":
        """log: chunk_id, ts."""
        rows = log.select("chunk_id", F.lit(1).cast("long").alias("n"), "ts")
        if not self.kept["accesses"]:
            rows = rows.unionByName(self.index.access.select("chunk_id", F.col("access_count").alias("n"), F.col("last_accessed").alias("ts")))
        self.kept["accesses"].append(rows)
        self._index = replace(self.index, access=self._access())
        return self

    def flush_conversations(self, messages: DataFrame, now: Column) -> "Engine":
        """Conversations of 100 characters at least, saved below session_log."""
        said = S.transcripts(messages)
        return self.save(said.select(F.col("conv_id").cast("long").alias("save_id"), now.alias("ts"), F.col("text").alias("content"), F.concat(F.lit("session_log."), "conv_id").alias("path"), F.lit(None).cast("string").alias("heading")))

    def flush_sessions(self, sessions: DataFrame) -> "Engine":
        """Sessions (conv_id, began, ended, text, n_turns; `sources.files.sessions`), each saved below session_log at its own time; nothing if the settings don't flush by themselves.

        A session that is flushed again, as a batch run anew does, replaces itself.
        """
        if not self.settings.auto_flush_on_compaction:
            return self
        began = F.date_format(F.to_utc_timestamp("began", F.current_timezone()), "yyyyMMddHHmmssSSS")
        conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("unknown"))
        path = F.concat(F.lit("session_log."), T.slug(conv), F.lit(".at_"), began, F.lit("_"), F.lower(F.hex(F.xxhash64(conv))))  # slugs of different names may be equal
        rows = sessions.select(F.xxhash64(path).alias("save_id"), F.col("ended").alias("ts"), F.col("text").alias("content"), path.alias("path"), F.lit("Session snapshot").alias("heading"))
        return self.save(rows, replace=True)

    def savings(self, hits: DataFrame) -> DataFrame:
        """tokens_saved and cost_avoided: the files behind the hits against what the hits take."""
        there = hits.select("chunk_id", "snippet").join(self.index.chunks.select("chunk_id", "source_file"), "chunk_id")
        files = self.index.chunks.join(there.select("source_file").distinct(), "source_file", "left_semi").agg(F.sum(F.octet_length("content")).alias("raw"))
        shown = there.agg(F.sum(F.octet_length("snippet")).alias("shown"))
        both = files.crossJoin(shown).select(T.tokens_saved(F.coalesce("raw", F.lit(0)), F.coalesce("shown", F.lit(0))).alias("tokens_saved"))  # one row each
        return both.withColumn("cost_avoided", T.cost_avoided("tokens_saved"))

    def record_savings(self, hits: DataFrame) -> dict:
        """What an answer saved is added to the total: tokens_saved, total_tokens_saved and the costs of both."""
        now = self.savings(hits).first()
        log = self.kept["savings"].append(self.spark.createDataFrame([(now["tokens_saved"],)], "tokens_saved long"))
        total = log.agg(F.sum("tokens_saved").alias("n")).select("n", T.cost_avoided("n").alias("cost")).first()
        return {"tokens_saved": now["tokens_saved"], "cost_avoided": now["cost_avoided"], "total_tokens_saved": total["n"], "total_cost_avoided": total["cost"]}


def savings_line(meta: dict) -> str:
    """What the savings come to, for people."""
    costs = ", ".join(f"{k}: ${v:.4f}" for k, v in (meta.get("total_cost_avoided") or {}).items())
    return f"{meta.get('total_tokens_saved') or 0:,} tokens saved" + (f" ({costs} avoided)" if costs else "")


def results(rows: DataFrame, most: int = 500) -> dict:
    """A small result in the form that a host's own search tool gives; internal columns go."""
    items = [r.asDict(recursive=True) for r in R.public(rows).limit(most).collect()]
    return {"results": items, "provider": "quarry", "model": "full-text", "fallback": False, "citations": "off", "mode": "quarry"}


def envelope(rows: DataFrame, began: float, most: int = 500) -> dict:
    """A small result as a dictionary; at most so many rows, as pages and searches have."""
    try:
        items = [r.asDict(recursive=True) for r in rows.limit(most).collect()]
    except Exception as e:  # an engine's answer says what went wrong
        return {"ok": False, "api_version": API_VERSION, "data": None, "error": {"code": getattr(e, "code", "DB_ERROR"), "message": str(e)}, "_meta": {}}
    return {"ok": True, "api_version": API_VERSION, "data": {"items": items}, "error": None, "_meta": {"timing_ms": round((time.time() - began) * 1000, 1)}}
