"""Code metrics from lines and functions up to projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import language_of
from ..functions.paths import folder
from ..functions.text import lines_of
from .windows import top_per_key

# Words that open a branch, and logical operators, per language family.
BRANCHES = {
    ("rust", "go", "java"): (["if", "for", "while", "match", "case", "catch"], ["else if"], ["&&", "||"]),
    ("typescript", "javascript"): (
        ["if", "for", "while", "do", "switch", "case", "catch"], ["else if"], ["&&", "||", "?"]),
    ("python",): (["if", "elif", "for", "while", "except", "case", "and", "or"], [], []),
    (): (["if", "for", "while", "case", "catch"], [], ["&&", "||"]),
}
# How a declaration line starts, per language.
DECLARATIONS = {
    "rust": "fn ", "python": "def ", "typescript": "function ", "javascript": "function ",
    "go": "func ", "java": "public ",
}
COMMON_DECLARATIONS = ["pub fn ", "async fn ", "async def ", "const fn ", "export function ", "export async function "]


def _language(files: DataFrame) -> Column:
    return F.col("language") if "language" in files.columns else language_of(F.col("path"))


def _line_counts(lines: Column, language: Column) -> Column:
    """struct<total_lines,sloc,comment_lines> of an array of lines.

    A block comment runs from the line that opens it to the line that closes it.
    """
    python = language == "python"
    opens = F.when(python, '"""').otherwise("/*")
    closes = F.when(python, '"""').otherwise("*/")
    single = F.when(python, "#").otherwise("//")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("sloc"),
                     F.lit(0).cast("bigint").alias("comments"))

    def step(state: Column, raw: Column) -> Column:
        line = F.trim(raw)
        blank = line == ""
        inside = state["inside"] | F.contains(line, opens)
        comment = inside | F.startswith(line, single) | line.startswith("*")
        return F.struct(
            F.when(blank, state["inside"]).otherwise(inside & ~F.contains(line, closes)).alias("inside"),
            (state["sloc"] + F.when(~blank & ~comment, 1).otherwise(0)).alias("sloc"),
            (state["comments"] + F.when(~blank & comment, 1).otherwise(0)).alias("comments"))

    # Tabs and carriage returns count as blank space at the ends of a line.
    bare = F.transform(lines, lambda raw: F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return F.aggregate(bare, start, step, lambda s: F.struct(
        F.size(lines).cast("bigint").alias("total_lines"), s["sloc"].alias("sloc"),
        s["comments"].alias("comment_lines")))


def _ratio(comments: Column, sloc: Column) -> Column:
    return F.when(sloc > 0, comments / sloc).otherwise(F.lit(0.0))


def line_metrics(files: DataFrame) -> DataFrame:
    """Total, source and comment lines and the comment ratio per file, without a shuffle."""
    df = files.select("path", _language(files).alias("language"), lines_of(F.col("content")).alias("_lines"))
    df = df.withColumn("m", _line_counts(F.col("_lines"), F.col("language")))
    return df.select("path", "language", "m.*",
                     _ratio(F.col("m.comment_lines"), F.col("m.sloc")).alias("comment_ratio"))


def attach_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with a symbol table's rows as an array, for tables not made by `with_symbols`."""
    s = F.struct("name", "kind", "line", "end_line")
    grouped = symbols.groupBy("path").agg(F.array_sort(F.collect_list(s)).alias("symbols"))
    return files.join(grouped, "path")


def function_bodies(files: DataFrame) -> DataFrame:
    """Body lines of every function in `symbols`: from its line to the brace that closes it.

    Python bodies end by indentation, at the symbol's `end_line`. Elsewhere a body
    that is never closed runs to the end of the file. `files` carries
    its symbols along (see `with_symbols`), so bodies need no join.
    """
    df = files.select("path", _language(files).alias("language"), "symbols",
                      lines_of(F.col("content")).alias("_lines"))
    df = df.select("path", "language", "_lines", F.explode_outer(F.filter(
        "symbols", lambda s: s["kind"].isin("function", "method"))).alias("s")).filter("s is not null")
    python = F.col("language") == "python"
    reach = F.when(python, (F.col("s.end_line") - F.col("s.line") + 1).cast("int")).otherwise(F.size("_lines"))
    df = df.select("path", "language", F.col("s.name").alias("name"), F.col("s.line").alias("line"),
                   F.slice("_lines", F.col("s.line").cast("int") + 1, reach).alias("_window"))
    # Only braces and line breaks matter for the end of a body.
    marks = F.split(F.array_join(F.transform(
        "_window", lambda text: F.regexp_replace(text, r"[^{}]", "")), "\n"), "")
    start = F.struct(F.lit(0).alias("line"), F.lit(0).alias("open"), F.lit(False).alias("started"),
                     F.lit(-1).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["open"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        closed = (c == "}") & s["started"] & (depth == 0) & (s["end"] < 0)
        return F.struct(
            (s["line"] + F.when(c == "\n", 1).otherwise(0)).alias("line"), depth.alias("open"),
            (s["started"] | (c == "{")).alias("started"),
            F.when(closed, s["line"]).otherwise(s["end"]).alias("end"))

    df = df.withColumn("_end", F.when(python, -1).otherwise(F.aggregate(marks, start, step, lambda s: s["end"])))
    body = F.when(F.col("_end") >= 0, F.slice("_window", F.lit(1), F.col("_end") + 1)).otherwise(F.col("_window"))
    return df.select("path", "language", "name", "line", body.alias("body"))


def _count(text: Column, words: list[str]) -> Column:
    # Word bounds are ASCII, as the metric defines them.
    regex = "(?<![A-Za-z0-9_])(?:" + "|".join(words) + ")(?![A-Za-z0-9_])"
    return F.regexp_count(text, F.lit(regex))


def _branch_count(line: Column, language: Column) -> Column:
    """Branch words outside comments plus logical operators anywhere on a line.

    `else if` counts as `else if` and as `if`; that is how the metric is defined.
    """
    comment = F.regexp_replace(line, r"^\s+", "").rlike(r"^(?://|#|\*|/\*)")
    code = F.when(comment, "").otherwise(F.substring_index(line, "//", 1))
    chosen = None
    fallback = None
    for languages, (words, pairs, operators) in BRANCHES.items():
        n = _count(code, words)
        if pairs:
            n = n + _count(code, pairs)
        if operators:
            marks = "|".join("".join("\\" + c for c in o) if o != "&&" else o for o in operators)
            n = n + F.regexp_count(line, F.lit(marks))
        if not languages:
            fallback = n
        else:
            test = language.isin(*languages)
            chosen = F.when(test, n) if chosen is None else chosen.when(test, n)
    return chosen.otherwise(fallback)


def complexity(bodies: DataFrame) -> DataFrame:
    """Cyclomatic and cognitive complexity and deepest nesting of each body.

    Cyclomatic is 1 + branches + logical operators. Cognitive weighs each by
    1 + brace depth at the end of its line and takes 1 off, never below 0, for
    a return, continue or break at depth 0.
    """
    language = F.col("language")
    known = [name for names in BRANCHES for name in names]
    leave = F.when(language.isin(*known), r"1").otherwise("0")

    def reduce_line(line: Column) -> Column:
        bare = F.regexp_replace(line, r"^\s+", "")
        early = F.when(leave == "1", bare.rlike(r"^(?:return|continue|break)")).otherwise(bare.startswith("return"))
        return F.struct(
            _branch_count(line, language).alias("n"), early.alias("early"),
            F.filter(F.split(F.regexp_replace(line, r"[^{}]", ""), ""), lambda c: c != "").alias("braces"))

    zero = lambda: F.lit(0)
    start = F.struct(zero().alias("depth"), zero().alias("deepest"), zero().alias("cyclomatic"), zero().alias("cognitive"))

    def nest(s: Column, c: Column) -> Column:
        depth = F.when(c == "{", s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0)))
        return F.struct(depth.alias("depth"), F.greatest(s["deepest"], depth).alias("deepest"))

    def step(s: Column, line: Column) -> Column:
        nested = F.aggregate(line["braces"], F.struct(s["depth"].alias("depth"), s["deepest"].alias("deepest")), nest)
        cognitive = s["cognitive"] + line["n"] * (1 + nested["depth"])
        relief = line["early"] & (nested["depth"] == 0)
        return F.struct(
            nested["depth"].alias("depth"), nested["deepest"].alias("deepest"),
            (s["cyclomatic"] + line["n"]).alias("cyclomatic"),
            F.when(relief, F.greatest(cognitive - 1, F.lit(0))).otherwise(cognitive).alias("cognitive"))

    df = bodies.withColumn("_reduced", F.transform("body", reduce_line))
    df = df.withColumn("_c", F.aggregate("_reduced", start, step))
    return df.drop("_reduced").select(
        *bodies.columns,
        (F.col("_c.cyclomatic") + 1).cast("bigint").alias("cyclomatic"),
        F.col("_c.cognitive").cast("bigint").alias("cognitive"),
        F.col("_c.deepest").cast("bigint").alias("max_nesting"))


def parameter_count(bodies: DataFrame) -> DataFrame:
    """Parameters in the first declaration, from its line on to the closing bracket: commas plus one, without `self`."""
    language = F.col("language")
    first = F.lit("fn ")
    for name, word in DECLARATIONS.items():
        first = F.when(language == name, word).otherwise(first)
    declares = F.filter("body", lambda line: F.startswith(F.ltrim(line), first) | F.ltrim(line).rlike(
        "^(?:" + "|".join(COMMON_DECLARATIONS) + ")"))
    line = F.coalesce(F.get(declares, F.lit(0)), F.lit(""))
    behind = F.slice("body", F.array_position("body", line).cast("int"), F.size("body"))
    whole = F.when(line.rlike(r"^[^(]*\([^)]*$"), F.array_join(behind, "\n")).otherwise(line)
    inner = F.regexp_replace(F.regexp_extract(whole, r"^[^(]*\(([^)]*)\)", 1), r",?\s+$|\n", "")
    df = bodies.withColumn("_p", F.trim(inner))
    p = F.col("_p")
    count = F.size(F.split(p, ",", -1))
    own = F.when(language == "python", p.startswith("self,") | (p == "self")).when(
        language == "rust", p.startswith("&self") | p.startswith("self") | p.startswith("&mut self")).otherwise(False)
    total = F.when(p == "", 0).otherwise(count - F.when(own, 1).otherwise(0))
    return df.withColumn("parameters", total.cast("bigint")).drop("_p")


def rating_of(score: Column) -> Column:
    return F.when(score <= 5, "simple").when(score <= 10, "moderate").when(score <= 20, "complex").otherwise(
        "very_complex")


# Advice by rating.
ADVICE = {
    "complex": "Consider refactoring to reduce complexity",
    "very_complex": "Strongly recommended to refactor into smaller functions",
}


def function_report(bodies: DataFrame) -> DataFrame:
    """All metrics of each function with rating, issues and recommendation.

    One row in, one row out: the whole chain from file to report is narrow.
    """
    df = parameter_count(complexity(bodies))
    df = df.withColumn("_m", _line_counts(F.col("body"), F.col("language")))
    df = df.select("path", "language", "name", "line", "cyclomatic", "cognitive", "max_nesting", "parameters",
                   "_m.*", _ratio(F.col("_m.comment_lines"), F.col("_m.sloc")).alias("comment_ratio"))
    rating = rating_of(F.col("cognitive"))
    issues = F.array_compact(F.array(
        F.when(F.col("cognitive") > 15, "cognitive_complexity"),
        F.when(F.col("parameters") > 5, "parameters"),
        F.when(F.col("max_nesting") > 4, "nesting"),
        F.when((F.col("comment_ratio") < 0.1) & (F.col("sloc") > 20), "comments")))
    df = df.withColumn("rating", rating).withColumn("issues", issues)
    advice = F.when(F.col("rating") == "complex", ADVICE["complex"]).when(
        F.col("rating") == "very_complex", ADVICE["very_complex"])
    return df.withColumn("recommendation", advice)


def _summary() -> list[Column]:
    needs = F.count_if(F.col("rating").isin("complex", "very_complex"))
    return [
        F.count("*").alias("functions"),
        F.sum("cyclomatic").alias("total_cyclomatic"),
        F.sum("cognitive").alias("total_cognitive"),
        F.avg("cyclomatic").alias("avg_cyclomatic"),
        F.avg("cognitive").alias("avg_cognitive"),
        F.max("cyclomatic").alias("max_cyclomatic"),
        F.max("cognitive").alias("max_cognitive"),
        F.sum("sloc").alias("total_sloc"),
        F.avg("sloc").alias("avg_sloc"),
        F.sum(F.size("issues")).cast("bigint").alias("issues"),
        needs.alias("needs_attention"),
    ]


def file_report(functions: DataFrame) -> DataFrame:
    """Sums, means and maxima over the functions of each file."""
    return functions.groupBy("path").agg(*_summary())


def class_report(functions: DataFrame) -> DataFrame:
    """Metrics per class: the name before the last dot, or `<module>`."""
    dotted = F.col("language").isin("python", "typescript", "javascript", "java") & F.col("name").contains(".")
    owner = F.when(dotted, F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)).otherwise("<module>")
    df = functions.groupBy("path", owner.alias("class")).agg(F.min("line").alias("line"), *[
        c for c in _summary()])
    issues = F.array_compact(F.array(
        F.when(F.col("avg_cognitive") > 10.0, "average_complexity"),
        F.when(F.col("functions") > 20, "many_methods")))
    return df.drop("issues", "needs_attention").withColumn(
        "rating", rating_of(F.col("avg_cognitive").cast("bigint"))).withColumn("class_issues", issues)


def project_report(functions: DataFrame) -> DataFrame:
    """Totals per file, folder, project and overall in one pass; the project is the first segment."""
    df = functions.withColumn("project", F.substring_index("path", "/", 1)).withColumn("dir", folder(F.col("path")))
    return df.rollup("project", "dir", "path").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("functions"),
        F.sum("cyclomatic").alias("total_cyclomatic"), F.sum("cognitive").alias("total_cognitive"),
        F.max("cognitive").alias("max_cognitive"), F.sum("sloc").alias("total_sloc"),
        F.sum(F.size("issues")).cast("bigint").alias("issues"))


def hotspots(report: DataFrame, metric: str = "cognitive", n: int = 10, per_project: bool = False) -> DataFrame:
    """The n worst rows by a metric, overall or per project."""
    order = [F.col(metric).desc(), *[F.col(c) for c in ("path", "line") if c in report.columns]]
    if not per_project:
        return report.orderBy(*order).limit(n)
    df = report.withColumn("project", F.substring_index("path", "/", 1))
    return top_per_key(df, ["project"], order, n)


RATINGS = ["simple", "moderate", "complex", "very_complex"]


def rating_distribution(functions: DataFrame) -> DataFrame:
    """Functions per rating, one column each, per project."""
    df = functions.withColumn("project", F.substring_index("path", "/", 1))
    return df.groupBy("project").pivot("rating", RATINGS).agg(F.count(F.lit(1))).na.fill(0)


def indent_census(files: DataFrame) -> DataFrame:
    """Indentation per file: tab, or the greatest common divisor of leading spaces (4 if none)."""
    df = files.select("path", F.filter(lines_of(F.col("content")), lambda l: l.rlike(r"\S")).alias("_lines"))
    widths = F.array_distinct(F.transform("_lines", lambda l: F.length(F.regexp_extract(l, "^( *)", 1))))
    tabs = F.exists("_lines", lambda l: l.startswith("\t"))
    df = df.select("path", tabs.alias("_tabs"), F.filter(widths, lambda w: w > 0).alias("_w"))

    def gcd(a: Column, b: Column) -> Column:
        # Euclid needs at most 45 steps for 32-bit numbers.
        start = F.struct(a.alias("a"), b.alias("b"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(45)), start,
            lambda s, _: F.when(s["b"] == 0, s).otherwise(
                F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))),
            lambda s: s["a"])

    size = F.aggregate("_w", F.get("_w", F.lit(0)), gcd)
    return df.select(
        "path", F.when(F.col("_tabs"), "tab").otherwise("space").alias("indent"),
        F.when(F.col("_tabs"), 1).when(F.size("_w") == 0, 4).otherwise(size).cast("bigint").alias("width"))


# Marks of tests and assertions.
TEST_MARKS = [r"#\[test\]", r"#\[tokio::test\]", r"#\[async_std::test\]", r"#\[actix_rt::test\]"]
ASSERTION_MARKS = [
    r"\bassert!\(", r"\bassert_eq!\(", r"\bassert_ne!\(",
    r"\bdebug_assert!\(", r"\bdebug_assert_eq!\(", r"\bdebug_assert_ne!\(",
]


def test_census(files: DataFrame) -> DataFrame:
    """Test annotations and assertion macros of the files that have any."""
    tests = F.regexp_count("content", F.lit("|".join(TEST_MARKS))).cast("bigint")
    asserts = F.regexp_count("content", F.lit("|".join(ASSERTION_MARKS))).cast("bigint")
    return files.select("path", tests.alias("tests"), asserts.alias("assertions")).filter(
        (F.col("tests") > 0) | (F.col("assertions") > 0))


def language_census(files: DataFrame) -> DataFrame:
    """Files, bytes and lines per language."""
    size = F.col("size_bytes") if "size_bytes" in files.columns else F.octet_length("content")
    lines = F.size(lines_of(F.col("content")))
    return files.groupBy(_language(files).alias("language")).agg(
        F.count("*").alias("files"), F.sum(size).cast("bigint").alias("bytes"), F.sum(lines).cast("bigint").alias("lines"))
