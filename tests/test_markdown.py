from __future__ import annotations

import re

from hypothesis import given, settings, strategies as st

from quarry.functions import markdown as M


def test_blocks_of_all_kinds():
    text = "---\r\na: 1\r\n---\r\n# T\npara\n\n> q\n\n> r\ntail\n| a | b |\n|---|---|\n| 1 | 2 |\n- x\n\n  y\n```py\n# no heading\n```\n## U\n1. z\n"
    kinds = [(b.kind, b.headings, b.start, b.end) for b in M.blocks(text)]
    assert kinds == [
        ("paragraph", ["T"], 5, 5), ("blockquote", ["T"], 7, 9), ("paragraph", ["T"], 10, 10), ("table", ["T"], 11, 13),
        ("list", ["T"], 14, 16), ("code", ["T"], 17, 19), ("list", ["T", "U"], 21, 22),
    ]


def test_open_fence_and_front_matter():
    assert [(b.kind, b.start, b.end) for b in M.blocks("```py\nx\ny")] == [("code", 1, 4)]
    assert [b.text for b in M.blocks("---\na: 1")] == ["---\na: 1"]


def test_chunks_have_bounded_sizes_and_orders():
    found = M.file_chunks("memory/x.md", "# A\n" + "w" * 1201 + "\n\n# A\n" + "\n\n".join("v" * 390 for _ in range(4)))
    assert [(p, n) for p, n, *_ in found] == [("memory.x.a", k) for k in range(len(found))]
    assert max(len(c) for _, _, c, _, _ in found) <= 1600


def test_paths_are_cut_at_six_levels():
    assert M.file_chunks("a/b/c/d/e.md", "# F\n## G\ntext")[0][0] == "a.b.c.d.e.f"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #-*>|`~\n1.:", max_size=300))
def test_text_outside_headings_is_kept(text):
    chunks = "".join(c for _, _, c, _, _ in M.file_chunks("m.md", text))
    blocks = "".join(b.text for b in M.blocks(text))
    bare = lambda x: re.sub(r"\s", "", x)
    assert bare(chunks) == bare(blocks)


def test_spark_chunks(spark):
    files = spark.createDataFrame([("memory/a.md", "# H\n- Name: X\n"), ("memory/b.md", None), ("memory/c.md", "")], "path string, text string")
    rows = M.chunks(files).collect()
    assert [(r["lookup_path"], r["content"], r["start_line"], r["end_line"], r["token_count"]) for r in rows] == [("memory.a.h", "- Name: X", 2, 2, 3)]
