"""Markdown files into blocks and chunks: a small per-file helper, run by Spark over rows of files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import build_lookup_path, parent_path, safe_text, token_count

HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
SEPARATOR = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$")
BULLET = re.compile(r"^(?:[-*]|\d+\.)\s+")
#: Tokens that a chunk should have at least and at most, at four characters a token.
LEAST, MOST = 100, 300


@dataclass
class Block:
    headings: list[str]
    start: int
    end: int
    kind: str
    text: str


@dataclass
class _Reader:
    """Lines of one file, by number; blocks are taken off one after the other."""

    lines: list[str]
    first: int
    at: int = 0
    stack: list[tuple[int, str]] = field(default_factory=list)

    def block(self, kind: str, begin: int, upto: int, strip: bool = True, end: int | None = None) -> Block:
        text = "\n".join(self.lines[begin:upto])
        return Block([h for _, h in self.stack], begin + self.first, (upto - 1 if end is None else end) + self.first, kind, text.strip() if strip else text)

    def span(self, goes_on) -> int:
        """The first line after this one that doesn't belong to the block."""
        k = self.at + 1
        while k < len(self.lines) and goes_on(self.lines[k]):
            k += 1
        return k

    def fenced(self) -> tuple[int, Block]:
        mark = FENCE.match(self.lines[self.at])[1]
        for k in range(self.at + 1, len(self.lines)):
            m = FENCE.match(self.lines[k])
            if m and m[1][0] == mark[0] and len(m[1]) >= len(mark):
                return k + 1, self.block("code", self.at, k + 1, strip=False)
        n = len(self.lines)  # without an end it reaches to the end of the file, and one line further
        return n, self.block("code", self.at, n, strip=False, end=n)

    def __iter__(self) -> Iterator[Block]:
        para = None  # first line of the open paragraph

        def closed(upto: int) -> list[Block]:
            b = self.block("paragraph", para, upto) if para is not None else None
            return [b] if b and b.text else []

        while self.at < len(self.lines):
            line = self.lines[self.at]
            bare = line.strip()
            upto, found = self.at + 1, None
            following = self.lines[upto] if upto < len(self.lines) else ""
            if FENCE.match(line):
                upto, found = self.fenced()
            elif heading := HEADING.match(line):
                yield from closed(self.at)
                para = None
                level = len(heading[1])
                self.stack = [h for h in self.stack if h[0] < level] + [(level, heading[2].strip())]
                self.at = upto
                continue
            elif bare.startswith(">"):
                upto = self.span(lambda x: not x.strip() or x.strip().startswith(">"))
                found = self.block("blockquote", self.at, upto)
            elif "|" in line and SEPARATOR.match(following):
                self.at += 1
                upto = self.span(lambda x: x.strip() and "|" in x)
                self.at -= 1
                found = self.block("table", self.at, upto)
            elif BULLET.match(bare):
                upto = self.span(lambda x: not x.strip() or BULLET.match(x.strip()) or x.startswith(("  ", "\t")))
                found = self.block("list", self.at, upto)
            elif bare:
                para = self.at if para is None else para
                self.at = upto
                continue
            yield from closed(self.at)
            para = None
            if found:
                yield found
            self.at = upto
        yield from closed(len(self.lines))


def blocks(text: str) -> list[Block]:
    """The blocks of a file with their headings; a closed front matter is left out, lines keep their numbers."""
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    first = 1
    if lines[0] == "---" and len(lines) > 1:
        ends = [k for k in range(1, len(lines)) if lines[k].strip() == "---"]
        if ends:
            lines, first = lines[ends[0] + 1 :] or [""], ends[0] + 2
    return list(_Reader(lines, first))


def _tokens(text: str) -> int:
    return max(1, (len(text) + 3) // 4)


def segments(block: Block, most_chars: int = 4 * MOST) -> list[tuple[str, int, int]]:
    """A block's lines packed into texts of bounded length, with first and last line; longer lines are cut."""
    out: list[tuple[str, int, int]] = []
    held: list[tuple[str, int]] = []

    def close() -> None:
        text = "\n".join(p for p, _ in held).strip()
        if text:
            out.append((text, held[0][1], held[-1][1]))
        held.clear()

    size = 0
    for k, line in enumerate(safe_text(block.text).strip().split("\n")):
        for lo in range(0, max(len(line), 1), most_chars):
            piece = line[lo : lo + most_chars]
            if held and size + len(piece) + 1 > most_chars:
                close()
                size = 0
            held.append((piece, block.start + k))
            size += len(piece) + 1
    if held:
        close()
    return out


def packed(found: list[tuple[tuple[str, ...], str, int, int]]) -> list[tuple[tuple[str, ...], str, int, int]]:
    """Neighbouring segments (path, text, first line, last line) under the same path, joined into chunks."""
    out = []
    held: list = []
    size = 0

    def close() -> None:
        nonlocal size
        if held:
            out.append((held[0][0], "\n\n".join(h[1] for h in held).strip(), held[0][2], held[-1][3]))
        held.clear()
        size = 0

    for seg in found:
        own = _tokens(seg[1])
        if held and (held[0][0] != seg[0] or own >= MOST or (size >= LEAST and size + own > MOST)):
            close()
        if own >= MOST:
            out.append(seg)
            continue
        held.append(seg)
        size += own
    close()
    return out


def _path_key(file: str, headings: list[str]) -> tuple[str, ...]:
    """What tells lookup paths of one file apart: slugs, neighbours once, six levels."""
    parts = [*re.sub(r"(?i)\.md$", "", file).split("/"), *headings]
    slugs = [re.sub(r"[^a-z0-9]+", "_", p.strip().lower()).strip("_") or "untitled" for p in parts if p != ""]
    once = [s for k, s in enumerate(slugs) if k == 0 or s != slugs[k - 1]]
    return tuple(once[:6])


def file_chunks(file: str, text: str) -> list[tuple[str, int, str, int, int]]:
    """lookup path, order within it, content, first and last line of a file's chunks."""
    found = [(_path_key(file, b.headings), *s) for b in blocks(text) for s in segments(b)]
    order: dict[tuple[str, ...], int] = {}
    out = []
    for path, content, lo, hi in packed(found):
        n = order[path] = order.get(path, -1) + 1
        out.append((".".join(path), n, content, lo, hi))
    return out


def chunks(files: DataFrame) -> DataFrame:
    """Chunks of files (path, text): lookup_path, parent_path, chunk_order, source, content, token_count, source_file, start_line, end_line, chunk_id.

    Files are parsed where they are read; no rows are moved.
    """
    names = ["source_file", "lookup_path", "chunk_order", "content", "start_line", "end_line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = [(f, *c) for f, t in zip(*(x.slice(lo, 500).to_pylist() for x in batch.columns)) for c in file_chunks(f, t or "")]
                columns = list(zip(*rows)) or [()] * 6
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = files.select("path", "text").mapInArrow(run, "source_file string, lookup_path string, chunk_order int, content string, start_line int, end_line int")
    return rows.select(
        F.xxhash64(F.lit("file"), "source_file", "lookup_path", "chunk_order").alias("chunk_id"),
        "lookup_path", parent_path("lookup_path").alias("parent_path"), "chunk_order", F.lit("file").alias("source"), "content",
        token_count("content").alias("token_count"), "source_file", "start_line", "end_line",
    )


__all__ = ["Block", "blocks", "segments", "packed", "file_chunks", "chunks", "build_lookup_path"]
