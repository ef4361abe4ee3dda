"""Finding text: literals, patterns, symbols, repeated literals, case styles."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casing import case_style
from ..functions.text import lines_of, occurrences, quoted, running_max, running_sum, unescaped_quotes

WORD_CHAR = r"[\p{IsAlphabetic}\p{N}_]"
GAP = "\uffff"


def _positions(df: DataFrame, gaps: str, hits: Column) -> DataFrame:
    """Turn gap texts and hit texts into one struct per hit, with offset, line and column.

    `hits` has one text per hit; `gaps` names a column with the texts around
    them, one more than there are hits.
    """
    hit_newlines = F.transform("_hits", lambda h: occurrences(h, "\n"))
    df = df.withColumn("_hits", hits).filter(F.size("_hits") > 0)
    df = df.withColumn(
        "_hit_end", running_sum(F.transform("_hits", lambda h: F.length(h).cast("bigint")))
    )
    df = df.withColumn(
        "_gap_end", running_sum(F.transform(gaps, lambda g: F.length(g).cast("bigint")))
    )
    df = df.withColumn("_gap_nl", running_sum(F.transform(gaps, lambda g: occurrences(g, "\n"))))
    df = df.withColumn("_hit_nl", running_sum(hit_newlines))

    def start(i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_hit_end"), i - 1))
        return F.get(F.col("_gap_end"), i) + before

    def after_newline(i: Column) -> Column:
        """Offset just behind the last line break in gap i or, failing that, in hit i-1."""
        gap = F.get(F.col(gaps), i)
        hit = F.get(F.col("_hits"), F.greatest(i - 1, F.lit(0)))
        gap_start = start(i) - F.length(gap)
        return (
            F.when(gap.contains("\n"), start(i) - F.length(F.substring_index(gap, "\n", -1)))
            .when((i > 0) & hit.contains("\n"),
                  gap_start - F.length(F.substring_index(hit, "\n", -1)))
            .otherwise(F.lit(0))
            .cast("bigint")
        )

    indexes = F.sequence(F.lit(0), F.size("_hits") - 1)
    df = df.withColumn("_line_start", running_max(F.transform(indexes, after_newline)))

    def match(i: Column) -> Column:
        text = F.get(F.col("_hits"), i)
        first_line = F.get(F.col("_gap_nl"), i) + F.when(i == 0, F.lit(0)).otherwise(
            F.get(F.col("_hit_nl"), i - 1)
        )
        lines = occurrences(text, "\n")
        column = start(i) - F.get(F.col("_line_start"), i)
        length = F.length(text)
        return F.struct(
            i.cast("bigint").alias("match_no"),
            start(i).cast("bigint").alias("start_off"),
            (start(i) + length).cast("bigint").alias("end_off"),
            first_line.cast("bigint").alias("line"),
            column.cast("bigint").alias("col"),
            (first_line + lines).cast("bigint").alias("end_line"),
            F.when(lines == 0, column + length)
            .otherwise(F.length(F.substring_index(text, "\n", -1)))
            .cast("bigint")
            .alias("end_col"),
            text.alias("matched_text"),
        )

    return df.withColumn("_matches", F.transform(indexes, match))


def _emit(df: DataFrame, keep: list[str], extra: list[str] = ()) -> DataFrame:
    out = df.select(*keep, F.explode_outer("_matches").alias("m")).filter("m is not null")
    return out.select(*keep, "m.*", *extra)


def literal_search(
    files: DataFrame, pattern: str, whole_word: bool = False, keep: tuple[str, ...] = ("path",)
) -> DataFrame:
    """One row per non-overlapping, case-sensitive hit, with 0-based offset, line and column.

    Whole words are picked from the plain hits, so a rejected hit still covers
    its characters. No shuffle: everything happens inside the file's row.
    """
    if not pattern:
        return regex_search(files.filter(F.lit(False)), "x", keep).drop("groups")
    df = files.filter(F.contains("content", F.lit(pattern)))
    df = df.select(*keep, F.split("content", quoted(pattern), -1).alias("_gaps"))
    df = _positions(df, "_gaps", F.array_repeat(F.lit(pattern), F.size("_gaps") - 1))
    if whole_word:
        first, last = F.lit(pattern[0]), F.lit(pattern[-1])

        def free(m: Column) -> Column:
            i = m["match_no"].cast("int")
            left, right = F.get(F.col("_gaps"), i), F.get(F.col("_gaps"), i + 1)
            before = F.when(left != "", F.substring(left, -1, 1)).when(i > 0, last).otherwise("")
            more = i + 1 < F.size("_hits")
            after = F.when(right != "", F.substring(right, 1, 1)).when(more, first).otherwise("")
            return ~before.rlike(WORD_CHAR) & ~after.rlike(WORD_CHAR)

        df = df.withColumn("_matches", F.filter("_matches", free))
    return _emit(df, list(keep))


@dataclass(frozen=True)
class Regex:
    """A checked pattern: Java text, number of groups, group numbers by name."""

    java: str
    groups: int
    names: dict[str, int]


def checked_regex(pattern: str) -> Regex:
    """Check a pattern before any job starts and name its groups by number.

    Names become numbers because Java group names cannot hold an underscore.
    Classes such as `\\w` and `\\b` are read as Unicode classes.
    """
    if not pattern:
        raise ValueError("empty pattern")
    try:
        compiled = re.compile(pattern.replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace(
            "(?P<!", "(?<!"))
    except re.error as problem:
        # Unicode property classes are unknown to this check but fine for the engine.
        probe = re.sub(r"\\[pP]\{[^}]*\}", "a", pattern)
        try:
            compiled = re.compile(probe.replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace(
                "(?P<!", "(?<!"))
        except re.error:
            raise ValueError(f"invalid pattern {pattern!r}: {problem}") from None
    java = re.sub(r"\(\?P?<(?![=!])[^>]+>", "(", pattern)
    return Regex("(?U)" + java, compiled.groups, dict(compiled.groupindex))


def regex_search(files: DataFrame, pattern: str, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """As `literal_search` for a regular expression; adds capture groups, group 0 first."""
    regex = checked_regex(pattern)
    df = files.filter(F.col("content").rlike(regex.java))
    # The marker for gaps is a code point that no text may contain.
    clean = F.translate(F.col("content"), GAP, "\ufffd")
    df = df.withColumn(
        "_gaps", F.split(F.regexp_replace(clean, regex.java, GAP), GAP, -1)
    )
    groups = [
        F.regexp_extract_all("content", F.lit(regex.java), F.lit(g))
        for g in range(1, regex.groups + 1)
    ]
    df = df.select(*keep, "_gaps",
                   F.regexp_extract_all("content", F.lit(regex.java), F.lit(0)).alias("_found"),
                   F.array(*groups).cast("array<array<string>>").alias("_groups"))
    df = _positions(df, "_gaps", F.col("_found"))
    df = df.withColumn(
        "_matches",
        F.transform(
            "_matches",
            lambda m: m.withField(
                "groups",
                F.concat(
                    F.array(m["matched_text"]),
                    F.transform("_groups", lambda g: F.get(g, m["match_no"].cast("int"))),
                ),
            ),
        ),
    )
    return _emit(df, list(keep))


def case_style_census(files: DataFrame, keys: tuple[str, ...] = ("language",)) -> DataFrame:
    """Identifiers per case style. Counted per distinct word first, so a word that fills
    a third of the corpus is classified once per task."""
    token = F.explode_outer(F.regexp_extract_all("content", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    words = files.select(*keys, token.alias("word")).filter("word is not null").groupBy(*keys, "word").agg(
        F.count("*").alias("n"))
    return words.groupBy(*keys, case_style(F.col("word")).alias("style")).agg(
        F.sum("n").alias("uses"), F.count("*").alias("identifiers"))


QUOTED_SPAN = r""""(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|`(?:\\.|[^`\\])*(?:`|$)"""

# A quoted span, a word, other characters, or a quote that opens no span.
LINE_TOKEN = QUOTED_SPAN + r"""|[\p{IsAlphabetic}\p{N}_]+|[^\p{IsAlphabetic}\p{N}_"'`]+|["'`]"""


def symbol_occurrences(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Word-bounded uses of many symbols outside quoted text, one row per use.

    Quoted spans are cut per line (a quote left open runs to the line's end).
    Every word is joined by hash to the symbol names.
    """
    lines = files.select("path", F.posexplode_outer(lines_of(F.col("content"))).alias("line", "text"))
    # One pass cuts a line into tokens without gaps, so that running lengths are places.
    tokens = F.regexp_extract_all("text", F.lit(LINE_TOKEN), F.lit(0))
    df = lines.filter(F.col("text").rlike(r"[\p{IsAlphabetic}\p{N}_]")).select("path", "line", tokens.alias("_tokens"))
    df = df.withColumn("_ends", running_sum(F.transform("_tokens", lambda t: F.length(t).cast("bigint"))))
    words = F.filter(F.zip_with("_tokens", "_ends", lambda t, e: F.struct(t.alias("name"), (e - F.length(t)).alias("col"))),
                     lambda u: u["name"].rlike(r"^[\p{IsAlphabetic}\p{N}_]"))
    uses = df.select("path", "line", F.explode_outer(words).alias("_u")).select(
        "path", F.col("line").cast("bigint").alias("line"), F.col("_u.col").alias("col"), F.col("_u.name").alias("name"))
    names = symbols.select("name").distinct()
    return uses.filter(F.col("name").isNotNull()).join(names, "name", "left_semi").select(
        "path", "name", "line", "col")


LITERAL = r""""[^"\n]*"|'[^'\n]*'|\d+(?:\.\d+)?"""


def code_at(line: Column, position: Column) -> Column:
    """True where a position lies neither in a quoted text nor in a comment of its line."""

    def even(text: Column) -> Column:
        odd = [unescaped_quotes(text, q) % 2 == 1 for q in ("'", '"', "`")]
        return ~(odd[0] | odd[1] | odd[2])

    slash = F.instr(line, "//") - 1
    open_block = F.length(line) - F.length(F.substring_index(line, "/*", -1)) - 2
    has_block = line.contains("/*")
    after = F.substring_index(line, "/*", -1)
    close = F.when(after.contains("*/"), open_block + F.instr(after, "*/") + 3).otherwise(
        F.length(line) + 1)
    before = lambda p: F.substring(line, F.lit(1), p.cast("int"))
    in_line_comment = (slash >= 0) & (position > slash) & even(before(slash))
    in_block = has_block & (position > open_block) & (position < close) & even(before(open_block))
    return even(before(position)) & ~in_line_comment & ~in_block


def literal_occurrences(files: DataFrame, min_uses: int = 2) -> DataFrame:
    """Number and string literals that repeat in code: uses and files per literal.

    These are the candidates for a named constant.
    """
    lines = files.select("path", F.explode_outer(lines_of(F.col("content"))).alias("line")).filter(
        F.col("line").rlike(r"[0-9\"']"))
    df = lines.withColumn("_hits", F.regexp_extract_all("line", F.lit(LITERAL), F.lit(0))).withColumn(
        "_gaps", F.split("line", LITERAL, -1)).filter(F.size("_hits") > 0)
    df = df.withColumn("_ends", running_sum(F.zip_with("_gaps", "_hits", lambda g, h: (
        F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("bigint"))))
    df = df.select("path", "line", F.explode_outer(F.arrays_zip(
        F.col("_hits").alias("literal"), F.col("_gaps").alias("gap"),
        F.slice("_ends", F.lit(1), F.size("_hits")).alias("end"))).alias("h"))
    df = df.select("path", "line", F.col("h.literal").alias("literal"), F.col("h.gap").alias("gap"),
                   (F.col("h.end") - F.length("h.literal")).alias("at")).filter(
        F.col("literal").isNotNull())
    inside_word = F.col("literal").rlike("^[0-9]") & F.col("gap").rlike(r"[\w.]$")
    found = df.filter(~inside_word & code_at(F.col("line"), F.col("at")))
    # Two steps, so that a literal used everywhere is pre-counted per file.
    per_file = found.groupBy("literal", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("literal").agg(
        F.sum("n").alias("uses"), F.count("*").alias("files")).filter(F.col("uses") >= min_uses)
