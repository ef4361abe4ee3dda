"""Changing text: find and replace, renames, path rewrites, line removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casing import case_style, in_style
from ..functions.text import bind, lines_of, quoted
from ..sources.corpus import Scope, apply_scope
from .search import WORD_CHAR, Regex, checked_regex, literal_search, regex_search


def template_parts(template: str, regex: Regex) -> list[str | int]:
    """Split a replacement template into plain texts and group numbers.

    `$0` is the hit, `$1` a group, `${name}` a named group, `$$` a dollar sign.
    Anything else behind a dollar sign is an error, raised before a job starts.
    """
    parts: list[str | int] = []
    i = 0
    while i < len(template):
        if template[i] != "$":
            end = template.find("$", i)
            end = len(template) if end < 0 else end
            parts.append(template[i:end])
            i = end
            continue
        rest = template[i + 1 :]
        digits = len(rest) - len(rest.lstrip("0123456789"))
        if rest.startswith("$"):
            parts.append("$")
            i += 2
        elif rest.startswith("{"):
            name, closed, _ = rest[1:].partition("}")
            if not closed or not name:
                raise ValueError(f"bad named group in template {template!r}")
            if name not in regex.names:
                raise ValueError(f"pattern has no group named {name!r}")
            parts.append(regex.names[name])
            i += len(name) + 3
        elif digits:
            number = int(rest[:digits])
            if number > regex.groups:
                raise ValueError(f"pattern has no group {number}")
            parts.append(number)
            i += digits + 1
        else:
            raise ValueError(f"bad dollar sign in template {template!r}")
    return parts


def _expanded(parts: list[str | int], groups: Column) -> Column:
    pieces = [F.lit(p) if isinstance(p, str) else F.get(groups, F.lit(p)) for p in parts]
    return F.concat(*pieces) if pieces else F.lit("")


def _java_template(parts: list[str | int]) -> str:
    escape = lambda text: text.replace("\\", "\\\\").replace("$", "\\$")
    out = []
    for index, p in enumerate(parts):
        if isinstance(p, str):
            # A digit behind a group number would be read as part of it.
            after_group = index > 0 and isinstance(parts[index - 1], int)
            text = escape(p)
            out.append("\\" + text if after_group and text[:1].isdigit() else text)
        else:
            out.append(f"${p}")
    return "".join(out)


def replace_preserving_case(edits: DataFrame, replacement: Column | None = None) -> DataFrame:
    """Re-style each edit's new text like its original text.

    The style is an expression on the row: no table of distinct hits, no join.
    """
    text = F.col("new_text") if replacement is None else replacement
    return edits.withColumn("new_text", in_style(text, case_style(F.col("original_text"))))


def find_replace(
    files: DataFrame,
    pattern: str,
    replacement: str,
    mode: str = "literal",
    whole_word: bool = False,
    preserve_case: bool = False,
    scope: Scope | str | None = None,
    plan_id: str = "find_replace",
    keep: tuple[str, ...] = ("path",),
) -> DataFrame:
    """Edits that replace every hit; nothing is changed yet (see `replaced_text`, `apply_edits`)."""
    if mode not in ("literal", "regex"):
        raise ValueError(f"unknown mode: {mode!r}")
    if not pattern:
        raise ValueError("empty pattern")
    if scope is not None:
        files = apply_scope(files, scope)
    if mode == "literal":
        hits = literal_search(files, pattern, whole_word, keep)
        new_text = F.lit(replacement)
    else:
        parts = template_parts(replacement, checked_regex(pattern))
        hits = regex_search(files, pattern, keep)
        new_text = _expanded(parts, F.col("groups"))
    edits = hits.select(
        F.lit(plan_id).alias("plan_id"),
        *keep,
        F.col("match_no").alias("edit_no"),
        F.lit("replace").alias("edit_type"),
        F.col("line").alias("start_line"),
        F.col("col").alias("start_col"),
        "end_line",
        "end_col",
        "start_off",
        "end_off",
        F.col("matched_text").alias("original_text"),
        new_text.alias("new_text"),
    )
    return replace_preserving_case(edits) if preserve_case else edits


def replaced_text(
    content: Column, pattern: str, replacement: str, mode: str = "literal",
    whole_word: bool = False,
) -> Column:
    """The text after `find_replace`, in one expression (also fit for streams)."""
    if not pattern:
        raise ValueError("empty pattern")
    if mode == "regex":
        regex = checked_regex(pattern)
        return F.regexp_replace(content, regex.java, _java_template(template_parts(replacement, regex)))
    if not whole_word:
        return F.replace(content, F.lit(pattern), F.lit(replacement))
    # Keep the plain left-to-right scan, then decide per hit from its neighbours.
    def rebuilt(gaps: Column) -> Column:
        return F.array_join(F.transform(gaps, lambda gap, i: piece(gaps, gap, i)), "")

    def piece(gaps: Column, gap: Column, i: Column) -> Column:
        following = F.get(gaps, i + 1)
        more = i + 2 < F.size(gaps)
        before = F.when(gap != "", F.substring(gap, -1, 1)).when(i > 0, pattern[-1]).otherwise("")
        after = F.when(following != "", F.substring(following, 1, 1)).when(
            more, pattern[0]).otherwise("")
        whole = ~before.rlike(WORD_CHAR) & ~after.rlike(WORD_CHAR)
        hit = F.when(following.isNull(), "").when(whole, replacement).otherwise(pattern)
        return F.concat(gap, hit)

    return F.when(content.contains(pattern), bind(F.split(content, quoted(pattern), -1), rebuilt)).otherwise(
        content)


def remove_lines(files: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Drop the lines a predicate holds for; line ending style and last break stay."""
    crlf = F.col("content").contains("\r\n")
    ending = F.when(crlf, "\r\n").otherwise("\n")
    df = files.select("*", lines_of(F.col("content")).alias("_lines"))
    df = df.withColumn("_kept", F.filter("_lines", lambda line: ~predicate(line)))
    body = F.when(crlf, F.array_join("_kept", "\r\n")).otherwise(F.array_join("_kept", "\n"))
    closed = F.when(F.col("content").endswith("\n") & (F.size("_kept") > 0),
                    F.concat(body, ending)).otherwise(body)
    removed = (F.size("_lines") - F.size("_kept")).cast("bigint")
    return df.select(
        "path", "content",
        F.when(removed == 0, F.col("content")).otherwise(closed).alias("new_content"),
        removed.alias("removed"))


def rename_conflicts(rename_map: DataFrame) -> DataFrame:
    """New names claimed by more than one old name, with the claimants' count and extremes.

    Any row means that the batch is rejected. The full list of claimants is the
    semi join of the map with this table, so no group is collected.
    """
    pairs = rename_map.select("old", "new").distinct()
    return (
        pairs.groupBy("new")
        .agg(F.count("*").alias("sources"), F.min("old").alias("first_source"),
             F.max("old").alias("last_source"))
        .filter(F.col("sources") > 1)
        .withColumn("code", F.lit("BATCH_RENAME_CONFLICT"))
    )


def bulk_rename(files: DataFrame, rename_map: DataFrame) -> DataFrame:
    """Many word-bounded renames over a corpus in one pass.

    Every file's distinct words meet the rename map in one hash join; each file
    gets the map of its own words back (never more than it has words) and is
    rewritten once, whatever the number of renames.
    """
    word = r"[\p{IsAlphabetic}\p{N}_]+"
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(word), F.lit(0)))
    uses = files.select("path", F.explode_outer(words).alias("old"))
    renames = rename_map.groupBy("old").agg(F.min("new").alias("new"))
    # Sort-merge joins: texts and maps made from small files outgrow what the planner reckons, and would be broadcast.
    per_file = uses.join(renames.hint("merge"), "old").groupBy("path").agg(
        F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_map"))
    df = files.join(per_file.hint("merge"), "path")
    df = df.withColumn("_words", F.regexp_extract_all("content", F.lit(word), F.lit(0)))
    df = df.withColumn("_gaps", F.split("content", word, -1))
    renamed = F.transform("_words", lambda w: F.coalesce(F.element_at("_map", w), w))
    df = df.withColumn("_new", renamed)
    rebuilt = F.array_join(F.zip_with("_gaps", "_new", lambda g, w: F.concat(
        g, F.coalesce(w, F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip("_words", "_new"), lambda z: z["_words"] != z["_new"]))
    return df.select("path", "content", rebuilt.alias("new_content"),
                     changed.cast("bigint").alias("renamed"))


# Endings that make a configuration value a path.
CONFIG_PATH_ENDINGS = [".rs", ".toml", ".yml", ".yaml", ".md", ".json", ".js", ".ts"]
# Endings that make a string literal a path.
STRING_PATH_ENDINGS = [
    ".py", ".pyi", ".json", ".yaml", ".yml", ".txt", ".md", ".toml", ".ini", ".cfg", ".conf",
    ".html", ".css", ".svg", ".png", ".jpg",
]


def path_like(text: Column, endings: list[str]) -> Column:
    suffix = "|".join(e.replace(".", "\\.") for e in endings)
    return text.contains("/") | text.contains("\\") | text.rlike(f"(?:{suffix})$")


def _first_replaced(text: Column, old: Column, new: Column) -> Column:
    at = F.instr(text, old)
    return F.concat(F.substring(text, F.lit(1), at - 1), new,
                    F.substring(text, at + F.length(old), F.length(text)))


def _fold_renames(lines: Column, renames: Column, rule) -> Column:
    """Apply an ordered array of (old, new) to every line."""
    return F.transform(lines, lambda line: F.aggregate(renames, line, lambda l, r: rule(l, r)))


# Fixed value: the most rows of a rename map that are sent to all tasks.
MAP_ROWS = 20_000


def _with_renames(files: DataFrame, rename_map: DataFrame, key: Column) -> DataFrame:
    """Give each file the renames whose old path it mentions, as one ordered array.

    Files and renames meet in an equi-join on path-like tokens of the text, so
    a map of any size works and files without a mention drop out.
    """
    token = F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\w.@~+-]+(?:[/\\][\w.@~+-]*)*"), F.lit(0)))
    # All runs of segments of a token are keys, so `a/b` is found in `../x/a/b/c.md`. A file's keys are made distinct in its row.
    runs = lambda text: bind(F.split(text, "/"), lambda parts: F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(
            F.sequence(F.lit(1), F.size(parts) - i + 1),
            lambda n: F.array_join(F.slice(parts, i, n), "/")))))
    keys = files.select("path", F.explode_outer(F.array_distinct(F.flatten(F.transform(token, runs)))).alias("_key"))
    renames = rename_map.select("old", "new", key.alias("_key")).distinct()
    # A map counted to be small meets the keys where they are; a large one, and the texts, are never broadcast.
    few = renames.limit(MAP_ROWS + 1).count() <= MAP_ROWS
    found = keys.join(renames.hint("broadcast" if few else "merge"), "_key").groupBy("path").agg(
        F.array_sort(F.collect_set(F.struct("old", "new"))).alias("_renames")).hint("merge")
    return files.join(found, "path")


def rewrite_config_paths(files: DataFrame, rename_map: DataFrame) -> DataFrame:
    """Rename paths in YAML values and list items, and in ignore-file patterns.

    Comments and keys stay; in YAML only the first mention per line changes;
    ignore patterns without a separator stay. A value that already holds the
    nested new path is left alone.
    """
    df = _with_renames(files, rename_map, F.col("old"))
    ignore = F.col("path").rlike(r"(?:^|/)\.[a-z]*ignore$")

    def yaml_rule(line: Column, r: Column) -> Column:
        at = F.instr(line, ":")
        head = F.when(at > 0, F.substring(line, F.lit(1), at)).otherwise("")
        value = F.when(at > 0, F.substring(line, at + 1, F.length(line))).otherwise(line)
        nested = r["new"].startswith(F.concat(r["old"], F.lit("/"))) & value.contains(r["new"])
        touch = value.contains(r["old"]) & path_like(F.trim(value), CONFIG_PATH_ENDINGS) & ~nested
        comment = F.trim(line).startswith("#") | (F.trim(line) == "")
        return F.when(touch & ~comment, F.concat(
            head, _first_replaced(value, r["old"], r["new"]))).otherwise(line)

    def ignore_rule(line: Column, r: Column) -> Column:
        bare = F.trim(line)
        touch = (bare.contains("/") | bare.contains("\\")) & bare.contains(r["old"])
        return F.when(touch & ~bare.startswith("#"),
                      F.replace(line, r["old"], r["new"])).otherwise(line)

    df = df.withColumn("_lines", lines_of(F.col("content")))
    df = df.withColumn("_new", F.when(ignore, _fold_renames(F.col("_lines"), F.col("_renames"), ignore_rule))
                       .otherwise(_fold_renames(F.col("_lines"), F.col("_renames"), yaml_rule)))
    return _rebuilt(df)


def _rebuilt(df: DataFrame) -> DataFrame:
    body = F.array_join("_new", "\n")
    text = F.when(F.col("content").endswith("\n"), F.concat(body, F.lit("\n"))).otherwise(body)
    changes = F.size(F.filter(F.arrays_zip("_lines", "_new"), lambda z: z["_lines"] != z["_new"]))
    return df.select("path", "content", text.alias("new_content"),
                     changes.cast("bigint").alias("changes")).filter(F.col("changes") > 0)


STRING_LITERAL = r"""(?<![frbFRB\w])f?(?:"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*')"""


def rewrite_string_paths(files: DataFrame, rename_map: DataFrame) -> DataFrame:
    """Rename paths inside string literals.

    A literal must look like a path and start with the old path, or, behind any
    `../`, with its last segment. Raw and byte strings and interpolated texts stay.
    """
    df = _with_renames(files, rename_map, F.substring_index("old", "/", -1))
    df = df.withColumn("_lines", F.regexp_extract_all("content", F.lit(STRING_LITERAL), F.lit(0)))
    df = df.withColumn("_gaps", F.split("content", STRING_LITERAL, -1))

    def rule(literal: Column, r: Column) -> Column:
        prefix = F.when(literal.startswith("f"), "f").otherwise("")
        quoted_part = F.when(literal.startswith("f"), F.substring(literal, F.lit(2), F.length(literal))).otherwise(literal)
        quote = F.substring(quoted_part, 1, 1)
        body = F.substring(quoted_part, F.lit(2), F.length(quoted_part) - 2)
        ups = F.regexp_extract(body, r"^(?:\.\.[/\\])*", 0)
        rest = F.substring(body, F.length(ups) + 1, F.length(body))
        old_name = F.substring_index(r["old"], "/", -1)
        new_name = F.substring_index(r["new"], "/", -1)

        def begins(text: Column, name: Column) -> Column:
            return (text == name) | text.startswith(F.concat(name, F.lit("/"))) | text.startswith(
                F.concat(name, F.lit("\\")))

        deeper = r["new"].startswith(F.concat(r["old"], F.lit("/")))
        nested = deeper & body.contains(r["new"])
        interpolated = literal.startswith("f") & body.contains("{")
        usable = path_like(body, STRING_PATH_ENDINGS) & ~nested & ~interpolated
        whole = F.concat(r["new"], F.substring(body, F.length(r["old"]) + 1, F.length(body)))
        named = F.concat(ups, F.when(deeper, r["new"]).otherwise(new_name), F.substring(rest, F.length(old_name) + 1, F.length(rest)))
        fresh = F.when(begins(body, r["old"]), whole).when(begins(rest, old_name), named)
        return F.when(usable & fresh.isNotNull(),
                      F.concat(prefix, quote, fresh, quote)).otherwise(literal)

    df = df.withColumn("_new", _fold_renames(F.col("_lines"), F.col("_renames"), rule))
    text = F.array_join(F.zip_with("_gaps", "_new", lambda g, n: F.concat(
        g, F.coalesce(n, F.lit("")))), "")
    changes = F.size(F.filter(F.arrays_zip("_lines", "_new"), lambda z: z["_lines"] != z["_new"]))
    return df.select("path", "content", text.alias("new_content"),
                     changes.cast("bigint").alias("changes")).filter(F.col("changes") > 0)
