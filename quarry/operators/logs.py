"""Logs that only grow, as a snapshot and a tail: appends are small tables, and enough of them are folded into the next snapshot.

Tables of a log are numbered. A snapshot holds all that came up to its number, so a reader takes the last snapshot that is complete
and the tables after it; what one snapshot replaced stays until the next one, for readers that began before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Tables of a tail that are folded.
TAIL = 32


@dataclass(frozen=True)
class Log:
    """fold: rows of the schema -> fewer rows of the schema that tell the same (by default all of them)."""

    spark: SparkSession
    path: str
    schema: str
    fold: Callable[[DataFrame], DataFrame] = lambda rows: rows

    def _tables(self) -> list[tuple[int, str, str]]:
        """(number, kind, place) of the complete tables, in order."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = []
        for f in fs.listStatus(p) if fs.exists(p) else []:
            kind, _, rest = f.getPath().getName().partition("-")
            if kind in ("tail", "snapshot") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
                out.append((int(rest.split("-")[0]), kind, f.getPath().toString()))
        return sorted(out)

    def _live(self) -> list[tuple[int, str, str]]:
        tables = self._tables()
        last = max((n for n, kind, _ in tables if kind == "snapshot"), default=-1)
        snapshots = [t for t in tables if t[:2] == (last, "snapshot")][:1]
        return snapshots + [t for t in tables if t[1] == "tail" and t[0] > last]

    def __bool__(self) -> bool:
        return bool(self._live())

    def rows(self) -> DataFrame:
        places = [p for *_, p in self._live()]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> DataFrame:
        """All rows, with these added."""
        number = max((n for n, *_ in self._tables()), default=-1) + 1
        none = self.spark.createDataFrame([], self.schema)
        rows.select(none.columns).coalesce(1).write.parquet(f"{self.path}/tail-{number:012d}-{uuid.uuid4().hex}")
        if sum(kind == "tail" for _, kind, _ in self._live()) >= TAIL:
            self.compact()
        return self.rows()

    def compact(self) -> None:
        """What there is becomes a snapshot; what was replaced by the one before goes."""
        tables = self._tables()
        live = self._live()
        if not live:
            return
        before = max((n for n, kind, _ in tables if kind == "snapshot"), default=-1)
        self.fold(self.rows()).select(self.spark.createDataFrame([], self.schema).columns).coalesce(1).write.parquet(f"{self.path}/snapshot-{max(n for n, *_ in live):012d}-{uuid.uuid4().hex}")
        for n, kind, place in tables:
            if n < before or (n == before and kind == "tail"):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(place)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
