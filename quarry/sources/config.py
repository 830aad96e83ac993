"""Settings of the engine, from a TOML file and the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

# Files that are left out, unless told otherwise.
EXCLUDED = [
    ".git/**", ".pytest_cache/**", "node_modules/**", ".venv/**", "dist/**", "build/**", ".secrets/**", "private/**",
    "**/*password*.md", "**/*secret*.md", "**/*token*.md",
]


@dataclass(frozen=True)
class Settings:
    db_path: str = ".index"
    roots: list[str] = field(default_factory=lambda: ["."])
    include_globs: list[str] = field(default_factory=lambda: ["MEMORY.md", "memory/**/*.md"])
    exclude_globs: list[str] = field(default_factory=lambda: list(EXCLUDED))
    follow_symlinks: bool = False
    max_tokens_per_query: int = 1200
    snippet_chars: int = 200
    auto_flush_on_compaction: bool = False


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Settings of a file; a missing or unreadable file gives the defaults. QUARRY_<NAME> in the environment comes first."""
    env = os.environ if environment is None else environment
    try:
        found = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        found = {}
    known = {k: v for k, v in found.items() if k in Settings.__dataclass_fields__}
    for k in Settings.__dataclass_fields__:
        if (v := env.get(f"QUARRY_{k.upper()}")) is not None:
            known[k] = v.split(",") if k in ("roots", "include_globs", "exclude_globs") else v.lower() in ("1", "true") if k in ("follow_symlinks", "auto_flush_on_compaction") else int(v) if k in ("max_tokens_per_query", "snippet_chars") else v
    s = replace(Settings(), **known)
    if path and not os.path.isabs(s.db_path):
        s = replace(s, db_path=str(Path(path).parent / s.db_path))
    return replace(s, roots=[os.path.expanduser(r) for r in s.roots], max_tokens_per_query=max(1, s.max_tokens_per_query), snippet_chars=max(40, s.snippet_chars))
