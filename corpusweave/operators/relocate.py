"""Moves end to end: from a map of renames to edits with places, and to the texts and paths after the move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import folder, joined, normalized, relative
from ..functions.statements import placed
from .edits import apply_edits
from .graph import moved_paths, redirected
from .imports import extract_imports, resolve_imports

#: Code blocks, code spans and comments, in which nothing is a link.
_SKIPPED = r"^ {0,3}```[^\n]*+\n.*?(?:^ {0,3}```[^\n]*+$|\z)|^ {0,3}~~~[^\n]*+\n.*?(?:^ {0,3}~~~[^\n]*+$|\z)|``[^\n]*?``|`[^`\n]++`|<!--.*?-->"
#: What follows the text of a link or an image: a target, and perhaps a title.
_TAIL = r"""\]\(\s*+<?+([^()\s<>]++)>?+(?:\s++(?:"[^"\n]*+"|'[^'\n]*+'))?+\s*+\)"""
_DEFINITION = r"^[ \t]*+\[[^\]\n]++\]:[ \t]*+<?+([^\s<>]++)>?+"
_AUTOLINK = r"<([^<>\s]++)>"
_MARKDOWN = rf"(?sm)(?:{_SKIPPED}|{_TAIL}|{_DEFINITION}|{_AUTOLINK}|[^\]`<\n~\[ \t]++|.)"
_LINKS = (("inline", _TAIL), ("definition", _DEFINITION), ("autolink", _AUTOLINK))


def link_places(files: DataFrame) -> DataFrame:
    """Links of Markdown texts with the place of their target: path, kind, target, line, start_off, end_off.

    Links, images, definitions and autolinks count, also where an image is the text of a link; what stands in code blocks, code spans and
    comments does not. Targets are given as written, anchors included.
    """
    whole = lambda regex: F.col("s.statement").rlike(f"(?sm)^(?:{regex})$")
    is_link = lambda t: t.rlike("(?sm)^(?:" + "|".join(r for _, r in _LINKS) + ")$") & ~t.rlike(r"^(?: {0,3}(?:```|~~~)|`|<!--)")
    tokens = F.when(F.col("content").rlike(r"\]\(|\]:|<"), F.regexp_extract_all("content", F.lit(_MARKDOWN), F.lit(0)))
    found = files.select("path", F.explode_outer(placed(tokens, is_link)).alias("s")).filter("s is not null")
    kind, target = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, regex in reversed(_LINKS):
        kind = F.when(whole(regex), name).otherwise(kind)
        target = F.when(whole(regex), F.regexp_extract("s.statement", f"(?sm)^(?:{regex})$", 1)).otherwise(target)
    rows = found.select("path", kind.alias("kind"), target.alias("target"), F.col("s.line").alias("line"), F.col("s.start_off").alias("_from"), F.col("s.statement").alias("_text"))
    # A definition's label may hold the target too: there, the last place counts.
    last = F.length("_text") - F.instr(F.reverse("_text"), F.reverse("target")) - F.length("target") + 1
    at = F.col("_from") + F.when(F.col("kind") == "definition", last).otherwise(F.instr("_text", F.col("target")) - 1)
    return rows.select("path", "kind", "target", "line", at.cast("bigint").alias("start_off"), (at + F.length("target")).cast("bigint").alias("end_off"))


def link_edits(links: DataFrame, files: DataFrame, moved: DataFrame) -> DataFrame:
    """Edits that keep `links` (from `link_places`) on the files they lead to, for `moved(old_path, new_path)`.

    Links that lead to no file of `files` stay. Anchors, a leading `./` and a leading `/` (the root) are kept.
    """
    local = links.filter(~F.col("target").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//|#)"))
    name, rooted = F.regexp_extract("target", r"^([^#?]*)", 1), F.col("target").startswith("/")
    to = F.when(rooted, F.regexp_replace(normalized(name), "^/+", "")).otherwise(joined(folder(F.col("path")), name))
    known = local.withColumn("_name", name).withColumn("_to", F.regexp_replace(to, "^/+", "")).filter(F.col("_name") != "").join(
        files.select(F.col("path").alias("_to")), "_to", "left_semi")
    there = moved.select(F.col("old_path").alias("_to"), F.col("new_path").alias("_new_to"))
    here = moved.select(F.col("old_path").alias("path"), F.col("new_path").alias("_new_path"))
    hit = known.join(there, "_to", "left").join(here, "path", "left").filter("_new_to is not null or _new_path is not null")
    new_to, new_path = F.coalesce("_new_to", "_to"), F.coalesce("_new_path", "path")
    seen = relative(folder(new_path), new_to)
    dotted = F.when(F.col("_name").startswith("./") & ~seen.startswith("../"), F.concat(F.lit("./"), seen)).otherwise(seen)
    text = F.when(rooted, F.concat(F.lit("/"), new_to)).otherwise(dotted)
    fresh = F.concat(text, F.substring("target", F.length("_name") + 1, F.length("target")))
    return hit.select("path", "line", "start_off", "end_off", F.lit("update_link").alias("edit_type"),
                      F.col("target").alias("original_text"), fresh.alias("new_text")).filter("new_text <> original_text")


def import_edits(resolved: DataFrame, moved: DataFrame) -> DataFrame:
    """`rewrite_references` with the place of each specifier; its place is the last one in its statement."""
    spec, statement = F.col("module_path"), F.col("statement")
    behind = F.instr(F.reverse(statement), F.reverse(spec)) - 1
    at = F.col("end_off") - behind - F.length(spec)
    hit = redirected(resolved, moved).filter(F.col("import_type").isin(
        "es_module", "type_only", "side_effect", "re_export", "common_js", "dynamic") & (behind >= 0))
    return hit.select("path", "line", at.cast("bigint").alias("start_off"), (at + F.length(spec)).cast("bigint").alias("end_off"),
                      F.lit("update_import").alias("edit_type"), spec.alias("original_text"), F.col("new_text"))


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:md|markdown|mdx)$")


def relocation_edits(files: DataFrame, moved: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """All edits that a move asks for: imports of scripts and links of Markdown files, each with its place."""
    resolved = resolve_imports(extract_imports(files), files, aliases)
    links = link_edits(link_places(files.filter(is_markdown(F.col("path")))), files, moved)
    return import_edits(resolved, moved).unionByName(links).withColumn("edit_no", F.col("start_off"))


def relocated_text(files: DataFrame, rename_map: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """path, new_path, new_content and edits of every file that moves, or whose text changes because of `rename_map(old, new)`."""
    moved = moved_paths(files, rename_map)
    changed = apply_edits(files, relocation_edits(files, moved, aliases)).select("path", "new_content", F.size("edits").cast("bigint").alias("edits"))
    there = moved.select(F.col("old_path").alias("path"), "new_path")
    out = files.select("path", "content").join(there, "path", "left").join(changed, "path", "left").filter("new_path is not null or new_content is not null")
    return out.select("path", F.coalesce("new_path", "path").alias("new_path"), F.coalesce("new_content", "content").alias("new_content"),
                      F.coalesce("edits", F.lit(0)).cast("bigint").alias("edits"))
