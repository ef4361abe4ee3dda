"""Languages by file extension, and the (language, kind, pattern) rows.

A new language is a new row here or a row passed by the caller; there is no
per-language code path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import extension

# Language names by extension.
LANGUAGE_BY_EXTENSION = {
    "rs": "rust",
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "py": "python",
    "pyi": "python",
    "go": "go",
    "java": "java",
    "swift": "swift",
    "cs": "csharp",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "hpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
}
# Languages known only by their import and symbol patterns.
PATTERN_LANGUAGE_BY_EXTENSION = {
    "lua": "lua",
    "sh": "shell",
    "bash": "shell",
    "zsh": "shell",
    "svelte": "svelte",
}

SCRIPT = ("typescript", "javascript", "svelte")


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def language_of(path: Column) -> Column:
    """Language reported for a path; `unknown` where the extension says nothing."""
    return _lookup(LANGUAGE_BY_EXTENSION, extension(path), F.lit("unknown"))


def pattern_language_of(path: Column) -> Column:
    """As `language_of`, also naming languages that only have pattern rows."""
    table = {**LANGUAGE_BY_EXTENSION, **PATTERN_LANGUAGE_BY_EXTENSION}
    return _lookup(table, extension(path), F.lit("unknown"))


@dataclass(frozen=True)
class Pattern:
    """One row: group `group` of `regex` on a line of `languages` gives a name of `kind`."""

    languages: tuple[str, ...]
    kind: str
    regex: str
    group: int = 1
    unless: str | None = None


# What a declaration looks like on one line.
SYMBOL_PATTERNS = [
    Pattern(("python",), "function", r"^\s*(?:async\s+)?def\s+(\w+)\s*[(\[]"),
    Pattern(("python",), "class", r"^\s*class\s+(\w+)"),
    Pattern(("python",), "constant", r"^\s*([A-Z_]+)\s*=\s*.+", 1, r"^\s*(?:async\s+)?def\s|^\s*class\s"),
    Pattern(("python",), "variable", r"^\s*(\w*[^A-Z_\W]\w*)\s*=\s*.+", 1,
            r"^\s*(?:async\s+)?def\s|^\s*class\s"),
    Pattern(("lua",), "function", r"^\s*(?:local\s+)?function\s+([\w.:]+)\s*\("),
    Pattern(("lua",), "function", r"^\s*([\w.]+)\s*=\s*function\s*\("),
    Pattern(("lua",), "variable", r"^\s*local\s+(\w+)\s*=\s*"),
    Pattern(("shell",), "function", r"^\s*(?:function\s+)?(\w[\w-]*)\s*\(\s*\)"),
    Pattern(("shell",), "variable", r"^\s*(?:export\s+|local\s+|declare\s+(?:-\w+\s+)*)?(\w+)="),
    Pattern(("shell",), "function", r"^\s*alias\s+([\w-]+)="),
    Pattern(SCRIPT, "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"),
    Pattern(SCRIPT, "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    Pattern(SCRIPT, "constant", r"^\s*(?:export\s+)?const\s+(\w+)"),
    Pattern(SCRIPT, "interface", r"^\s*(?:export\s+)?interface\s+(\w+)"),
    Pattern(("rust",), "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?fn\s+(\w+)"),
    Pattern(("rust",), "struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"),
    Pattern(("rust",), "enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"),
    Pattern(("go",), "function", r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)"),
    Pattern(("java",), "class", r"^\s*(?:public\s+)?(?:abstract\s+|final\s+)?class\s+(\w+)"),
]


def first_hits(line: Column, language: Column, patterns: list[Pattern]) -> Column:
    """array<struct<kind,name>> of every pattern row that fits a line of a language.

    The patterns are literals, so each is compiled once per task.
    """
    hits = []
    for p in patterns:
        fits = language.isin(*p.languages)
        if p.unless:
            fits = fits & ~line.rlike(p.unless)
        name = F.when(fits, F.regexp_extract(line, p.regex, p.group)).otherwise("")
        hits.append(F.struct(F.lit(p.kind).alias("kind"), F.trim(name).alias("name")))
    return F.filter(F.array(*hits), lambda h: h["name"] != "")
