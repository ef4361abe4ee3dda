"""Declarations, outlines and symbol search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import SYMBOL_PATTERNS, Pattern, first_hits, pattern_language_of
from ..functions.text import bind, lines_of, running, running_sum
from .windows import page


def _indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


# Strings and comments of Python, and what lies between them.
_PYTHON_TOKENS = (r"""(?s)(?:#[^\n]*+|\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''"""
                  r"""|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[^"'#]++|.)""")


def code_lines(content: Column) -> Column:
    """Lines of a Python text with comments and the insides of strings blanked out, so that brackets and indents in them do not count."""
    blank = lambda t: F.when(t.rlike(r"(?s)^#"), F.regexp_replace(t, r"[^\n]", " ")).when(
        t.rlike(r"""(?s)^(["']).*\1$""") & (F.length(t) > 1), F.concat(
            F.lit("'"), F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"[^\n]", " "), F.lit("'"))).otherwise(t)
    return lines_of(F.array_join(F.transform(F.regexp_extract_all(content, F.lit(_PYTHON_TOKENS), F.lit(0)), blank), ""))


def _bracket_depths(lines: Column) -> Column:
    """Open brackets at the end of each line."""
    count = lambda line, marks: F.length(F.regexp_replace(line, f"[^{marks}]", "")).cast("bigint")
    return running_sum(F.transform(lines, lambda line: count(line, r"(\[{") - count(line, r")\]}")))


def _next_closers(depths: Column, level: Column) -> Column:
    """For each line, the first line from there on that is indented no deeper than `level`; one pass from the back."""
    at = F.transform(depths, lambda d, i: F.when(d <= level, i.cast("bigint")))
    return F.reverse(running(F.reverse(at), F.lit(None).cast("bigint"), lambda carry, x: F.coalesce(x, carry)))


def with_symbols(files: DataFrame, extra: tuple[Pattern, ...] = ()) -> DataFrame:
    """Add `symbols`, an array of struct<name,kind,line,end_line>, in the file's own row.

    A Python function or class ends before the next line that is indented no deeper; blank lines, comments, the insides of
    strings and lines within brackets do not count, and neither are they declarations. A signature may run over
    several lines. Everything else ends where it starts. Lines count from 0. Ends are found by one pass from
    the back for each depth at which a file declares something.
    """
    language = F.col("language") if "language" in files.columns else pattern_language_of(F.col("path"))
    python = F.col("language") == "python"
    patterns = [*SYMBOL_PATTERNS, *extra]
    scoped = lambda s: python & s["kind"].isin("function", "class")

    def statement_depths(code: Column) -> Column:
        """Depth of each line that begins a statement; others get none."""
        return bind(_bracket_depths(code), lambda opened: F.transform(code, lambda text, i: F.when(
            text.rlike(r"\S") & ((i == 0) | (F.get(opened, i - 1) <= 0)), _indent(text))))

    def found_in(lines: Column, depths: Column) -> Column:
        candidates = F.filter(
            F.transform(lines, lambda text, i: F.struct(i.alias("line"), text.alias("text"))),
            lambda c: c["text"].rlike(r"\S") & (~python | F.get(depths, c["line"]).isNotNull()))
        return F.flatten(F.transform(candidates, lambda c: F.transform(
            first_hits(c["text"], F.col("language"), patterns),
            lambda h: F.struct(c["line"].alias("line"), h["kind"].alias("kind"), h["name"].alias("name"),
                               _indent(c["text"]).alias("indent")))))

    def with_ends(lines: Column, depths: Column, found: Column) -> Column:
        levels = F.array_distinct(F.transform(F.filter(found, scoped), lambda s: s["indent"]))

        def ended(levels: Column, closers: Column) -> Column:
            def end_line(s: Column) -> Column:
                own = F.get(closers, (F.array_position(levels, s["indent"]) - 1).cast("int"))
                return F.when(scoped(s), F.coalesce(F.get(own, s["line"] + 1) - 1, F.size(lines) - 1)).otherwise(s["line"])

            return F.transform(found, lambda s: F.struct(
                s["name"].alias("name"), s["kind"].alias("kind"), s["line"].cast("bigint").alias("line"),
                end_line(s).cast("bigint").alias("end_line")))

        return bind(levels, lambda v: bind(F.transform(v, lambda d: _next_closers(depths, d)), lambda x: ended(v, x)))

    # Arrays that inner steps look up are bound: an expression would be computed anew for each element.
    symbols = bind(lines_of(F.col("content")), lambda lines: bind(
        F.when(python, bind(code_lines(F.col("content")), statement_depths)),
        lambda depths: bind(found_in(lines, depths), lambda found: with_ends(lines, depths, found))))
    return files.withColumn("language", language).withColumn("symbols", symbols)


def extract_symbols(files: DataFrame, extra: tuple[Pattern, ...] = ()) -> DataFrame:
    """One row per declaration: path, name, kind, line and end line."""
    rows = with_symbols(files, extra).select("path", "language", F.explode_outer("symbols").alias("s")).filter("s is not null")
    return rows.select("path", "language", "s.*")


def outline(files: DataFrame, html: bool = False, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Headings with level; level 1 is a module, 2 a class, 3 a function, deeper ones other."""
    if html:
        heads = F.regexp_extract_all("content", F.lit(r"(?is)<(h[1-6])(?:\s[^>]*)?>"), F.lit(1))
        titles = F.regexp_extract_all("content", F.lit(r"(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]>"), F.lit(1))
        rows = files.filter(F.col("content").rlike("(?i)<h[1-6]")).select(
            *keep, F.posexplode_outer(F.arrays_zip(heads.alias("h"), titles.alias("t"))).alias("position", "z"))
        level = F.substring("z.h", 2, 1).cast("bigint")
        title = F.trim(F.regexp_replace("z.t", "<[^>]*>", ""))
        rows = rows.select(*keep, F.col("position").cast("bigint").alias("position"),
                           level.alias("level"), title.alias("title")).filter(F.col("title").isNotNull())
    else:
        lines = files.select(*keep, F.posexplode_outer(lines_of(F.col("content"))).alias("position", "line"))
        mark = F.regexp_extract("line", r"^(#{1,6})\s+.+$", 1)
        rows = lines.filter(mark != "").select(
            *keep, F.col("position").cast("bigint").alias("position"),
            F.length(mark).cast("bigint").alias("level"),
            F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)).alias("title"))
    kind = F.when(F.col("level") == 1, "module").when(F.col("level") == 2, "class").when(
        F.col("level") == 3, "function").otherwise("other")
    return rows.withColumn("kind", kind)


# Names a caller may use for a kind.
KIND_NAMES = {
    "function": "function", "func": "function", "fn": "function",
    "class": "class",
    "interface": "interface",
    "struct": "struct", "structure": "struct",
    "enum": "enum", "enumeration": "enum",
    "variable": "variable", "var": "variable", "let": "variable",
    "constant": "constant", "const": "constant",
    "module": "module", "mod": "module", "namespace": "module",
    "method": "method",
    "field": "field", "property": "field",
    "type": "other", "typedef": "other", "trait": "other",
}


def matching_symbols(symbols: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Symbols whose name contains the query in any case; unknown kind names filter nothing."""
    found = symbols.filter(F.lower("name").contains(query.lower())) if query else symbols
    wanted = KIND_NAMES.get(kind.lower()) if kind else None
    return found.filter(F.col("kind") == wanted) if wanted else found


def search_symbols(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 50,
                   offset: int = 0) -> DataFrame:
    """One page of the matching symbols in path order, with the total before paging."""
    return page(matching_symbols(symbols, query, kind), ["path", "line", "name", "kind"], offset, limit)
