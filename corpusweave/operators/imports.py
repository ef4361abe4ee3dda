"""Imports and links: extraction, bound names, resolution to files, externals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import Pattern, first_hits, pattern_language_of
from ..functions.paths import file_name, folder, joined, normalized, without_extension
from ..functions.statements import parts_of, statements_of
from ..functions.text import lines_of

# Endings tried for a specifier without one, in order.
SOURCE_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".rs"]


def _languages(files: DataFrame) -> Column:
    return F.col("language") if "language" in files.columns else pattern_language_of(F.col("path"))


def _tidy_tree(tree: Column) -> Column:
    """A Rust use tree on one line."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(tree, r"\{ ", "{"), r",? ?\}", "}"), r" ?:: ?", "::")


def _in_lines(content: Column, language: Column, patterns: list[Pattern]) -> Column:
    """Imports that one line shows, by patterns that the caller brings."""
    row = lambda line, i: F.transform(first_hits(line, language, patterns), lambda h: F.struct(
        F.lit(None).cast("bigint").alias("start_off"), F.lit(None).cast("bigint").alias("end_off"), i.cast("bigint").alias("line"),
        line.alias("statement"), F.lit("").alias("newline"), h["kind"].alias("kind"), h["name"].alias("module"), F.lit("").alias("clause")))
    return F.flatten(F.transform(lines_of(content), row))


def extract_imports(
    files: DataFrame, extra: tuple[Pattern, ...] = (), keep: tuple[str, ...] = ("path",)
) -> DataFrame:
    """One row per import: module path, kind, line number, statement and its place; re-exports and imports for side effects too.

    Statements are read whole, over as many lines as they take, and not from comments or strings. All grammars are rows of one list
    (`functions/statements.py`); `extra` adds patterns for single lines of further languages. `import a, b` is one row per module.
    `clause` holds the bound names, `newline` the line end behind a statement that has its lines to itself.
    """
    language = F.col("language")
    df = files.select(*keep, _languages(files).alias("language"), "content")
    found = df.select(*keep, "language", *(["content"] if extra else []),
                      F.explode_outer(statements_of(F.col("content"), language)).alias("s"))
    whole = found.filter("s is not null").select(
        *keep, "language", "s.*", parts_of(F.col("s.statement"), language).alias("p"))
    items = F.split("p.clause", r" ?, ?")
    several = F.when(F.col("p.kind") == "python_import", F.transform(
        items, lambda i: F.struct(F.substring_index(i, " ", 1).alias("module"), i.alias("clause")))).otherwise(F.array(F.struct(
            F.when(F.col("p.kind") == "rust_use", _tidy_tree(F.col("p.module"))).otherwise(F.col("p.module")).alias("module"),
            F.when(F.col("p.kind") == "rust_use", _tidy_tree(F.col("p.module"))).otherwise(F.col("p.clause")).alias("clause"))))
    rows = whole.select(*keep, "language", "start_off", "end_off", "line", "statement", "newline", F.col("p.kind").alias("kind"),
                        F.explode_outer(several).alias("m")).select("*", "m.module", "m.clause").drop("m")
    if extra:
        lined = df.select(*keep, "language", F.explode_outer(_in_lines(F.col("content"), language, list(extra))).alias("s")).filter(
            "s is not null").select(*keep, "language", "s.*")
        rows = rows.unionByName(lined)
    kind = F.col("kind")
    typed = (kind == "type_only") | ((kind == "re_export") & F.col("clause").startswith("type "))
    return rows.select(
        *keep, "language", F.col("module").alias("module_path"), kind.alias("import_type"),
        typed.alias("type_only"), "line", "statement", "clause", "start_off", "end_off", "newline")


def _named(inner: Column) -> Column:
    items = F.filter(F.transform(F.split(inner, ","), lambda i: F.trim(i)), lambda i: i != "")

    def one(item: Column) -> Column:
        typed = item.startswith("type ")
        bare = F.when(typed, F.substring(item, F.lit(6), F.length(item))).otherwise(item)
        alias = F.when(bare.contains(" as "), F.trim(F.regexp_extract(bare, r" as (.*)$", 1)))
        name = F.trim(F.substring_index(bare, " as ", 1))
        return F.struct(F.lit("named").alias("binding"), name.alias("name"), alias.alias("alias"),
                        typed.alias("type_only"))

    return F.transform(items, one)


def _leaves(tree: Column) -> Column:
    """Leaves of a Rust use tree as a list in braces: what stands before an opening brace is a prefix, no name."""
    runs = F.regexp_extract_all(tree, F.lit(r"[^{},]+\{?"), F.lit(0))
    names = F.transform(F.filter(runs, lambda r: ~r.endswith("{") & (F.trim(r) != "")), lambda r: F.trim(F.substring_index(r, "::", -1)))
    return F.concat(F.lit("{"), F.array_join(names, ","), F.lit("}"))


def import_bindings(imports: DataFrame) -> DataFrame:
    """One row per bound name: default, namespace, or named with its alias; `re_export` for names that are only handed on."""
    kind, clause = F.col("import_type"), F.col("clause")
    listed = (
        F.when(kind.isin("es_module", "type_only"), clause)
        .when(kind == "re_export", F.regexp_replace(F.regexp_replace(clause, r"^type ", ""), r"^\*(.*)$", r"{*$1}"))
        .when(kind == "python_from_import", F.concat(F.lit("{"), F.regexp_replace(clause, r"[()]", ""), F.lit("}")))
        .when(kind == "python_import", F.concat(F.lit("* as "), F.coalesce(
            F.nullif(F.regexp_extract(clause, r" as (\w+)", 1), F.lit("")), F.col("module_path"))))
        .when(kind == "rust_use", _leaves(clause))
        .otherwise("")
    )
    df = imports.withColumn("_clause", listed).filter(F.col("_clause") != "")
    c = F.col("_clause")
    none = F.array().cast("array<struct<binding:string,name:string,alias:string,type_only:boolean>>")
    lead = F.trim(F.regexp_extract(c, r"^([^{*,]*)", 1))
    default = F.when(lead != "", F.array(F.struct(
        F.lit("default").alias("binding"), lead.alias("name"), F.lit(None).cast("string").alias("alias"),
        F.lit(False).alias("type_only")))).otherwise(none)
    star = F.trim(F.regexp_extract(c, r"^[^{]*\*\s*as\s+(.*)$", 1))
    namespace = F.when(star != "", F.array(F.struct(
        F.lit("namespace").alias("binding"), star.alias("name"), F.lit(None).cast("string").alias("alias"),
        F.lit(False).alias("type_only")))).otherwise(none)
    named = F.when(c.contains("{"), _named(F.regexp_extract(c, r"\{(.*)\}", 1))).otherwise(none)
    out = df.select("path", "module_path", "line", "import_type", F.col("type_only").alias("_typed"),
                    F.explode_outer(F.concat(default, namespace, named)).alias("b")).filter("b is not null")
    handed_on = F.col("import_type") == "re_export"
    return out.select(
        "path", "module_path", "line", F.when(handed_on, "re_export").otherwise(F.col("b.binding")).alias("binding"), "b.name", "b.alias",
        (F.col("b.type_only") | F.col("_typed")).alias("type_only"),
        F.when(~handed_on, F.coalesce(F.col("b.alias"), F.col("b.name"))).alias("local_name"))


# What a link looks like.
INLINE_LINK = r"!?\[[^\]]+\]\(([^)]+)\)"
LINK_DEFINITION = r"(?m)^[ \t]*\[[^\]]+\]:[ \t]*(\S+)"
AUTOLINK = r"<([^>]+)>"
HREF = r"""href=["']([^"']*)["']"""


def extract_links(files: DataFrame, html: bool = False, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Links to files: inline, definitions and autolinks of Markdown, or HTML `href`.

    URLs, mail addresses and bare anchors drop out; anchors and a leading `./`
    are cut off.
    """
    c = F.col("content")
    found = lambda regex, kind: F.transform(
        F.regexp_extract_all(c, F.lit(regex), F.lit(1)),
        lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))
    sources = [found(HREF, "href")] if html else [
        found(INLINE_LINK, "inline"), found(LINK_DEFINITION, "definition"), found(AUTOLINK, "autolink")]
    may = c.contains("href=") if html else (
        c.contains("](") | c.contains("]:") | (c.contains("<") & c.contains(">")))
    links = files.filter(may).select(*keep, F.explode_outer(F.concat(*sources)).alias("l"))
    target = F.col("l.target")
    links = links.filter(~target.rlike(r"^(?:http://|https://|mailto:|ftp://|#)"))
    clean = F.regexp_replace(F.substring_index(target, "#", 1), r"^(?:\./)+", "")
    return links.select(*keep, F.col("l.kind").alias("kind"), clean.alias("target")).filter(
        F.col("target") != "")


def scan_references(files: DataFrame, modules: DataFrame, scope: str = "all") -> DataFrame:
    """Uses of modules: declarations, qualified paths and string literals.

    `scope` is `declarations`, `qualified_paths` or `all`. Every dotted name and
    every quoted path segment of a line is a join key, so the corpus is read
    once and joined by hash whatever the number of modules.
    """
    if scope not in ("declarations", "qualified_paths", "all"):
        raise ValueError(f"unknown scan scope: {scope!r}")
    lines = files.select("path", F.posexplode_outer(lines_of(F.col("content"))).alias("line", "text"))
    text = F.col("text")
    none = F.array().cast("array<struct<kind:string,module:string>>")
    tag = lambda kind, names: F.transform(
        names, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("module")))

    def prefixes(name: Column) -> Column:
        parts = F.split(name, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda n: F.array_join(F.slice(parts, 1, n), "."))

    declared = F.flatten(F.transform(F.concat(
        F.regexp_extract_all("text", F.lit(r"import ([\w.]+)"), F.lit(1)),
        F.regexp_extract_all("text", F.lit(r"from ([\w.]+)"), F.lit(1))), prefixes))
    unquoted = F.regexp_replace(text, r""""[^"]*"|'[^']*'""", " ")
    dotted = F.regexp_extract_all(unquoted, F.lit(r"[\w.]+\."), F.lit(0))
    qualified = F.flatten(F.transform(dotted, lambda d: prefixes(F.regexp_replace(d, r"\.$", ""))))
    strings = F.regexp_extract_all(text, F.lit(r""""([^"]*)"|'([^']*)'"""), F.lit(0))
    inside = F.flatten(F.transform(strings, lambda s: F.flatten(F.transform(
        F.regexp_extract_all(s, F.lit(r"[\w.]+"), F.lit(0)), prefixes))))
    sets = []
    if scope != "qualified_paths":
        sets.append(tag("declaration", F.array_distinct(declared)))
    if scope != "declarations":
        sets.append(tag("qualified_path", qualified))
    if scope == "all":
        sets.append(tag("string_literal", F.array_distinct(inside)))
    found = lines.select("path", F.col("line").cast("bigint").alias("line"),
                         F.explode_outer(F.concat(none, *sets)).alias("r")).select(
        "path", "line", "r.kind", "r.module")
    return found.join(modules.select("module").distinct(), "module", "left_semi").select(
        "path", "line", "kind", "module")


def _apply_aliases(imports: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Replace alias specifiers (`@/*` and the like) by paths below the project root."""
    if aliases is None:
        return imports.withColumn("_spec", F.col("module_path"))
    # Patterns meet specifiers on the text before the wildcard: one key per prefix length.
    star = aliases.select(
        F.substring_index("pattern", "*", 1).alias("_prefix"),
        F.when(F.col("pattern").contains("*"), F.substring_index("pattern", "*", -1)).alias("_suffix"),
        "replacement", "rank")
    specs = imports.select("module_path").distinct()
    keyed = specs.select("module_path", F.explode_outer(F.transform(
        F.sequence(F.lit(0), F.length("module_path")),
        lambda n: F.substring(F.col("module_path"), F.lit(1), n))).alias("_prefix"))
    hit = keyed.join(star, "_prefix").filter(
        F.when(F.col("_suffix").isNull(), F.col("module_path") == F.col("_prefix")).otherwise(
            F.col("module_path").endswith(F.col("_suffix"))
            & (F.length("module_path") >= F.length("_prefix") + F.length("_suffix"))))
    captured = F.substring("module_path", F.length("_prefix") + 1,
                           F.length("module_path") - F.length("_prefix")
                           - F.coalesce(F.length("_suffix"), F.lit(0)))
    target = F.when(F.col("replacement").contains("*"), F.replace("replacement", F.lit("*"), captured)
                    ).otherwise(F.col("replacement"))
    best = hit.groupBy("module_path").agg(F.min_by(target, "rank").alias("_to"))
    out = imports.join(best, "module_path", "left")
    # A path below the root is marked with a leading slash and read as such below.
    rooted = F.when(F.col("_to").startswith("/") | F.col("_to").startswith("./"), F.col("_to")
                    ).otherwise(F.concat(F.lit("/"), F.col("_to")))
    return out.withColumn("_spec", F.coalesce(rooted, F.col("module_path"))).drop("_to")


def resolve_imports(
    imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None
) -> DataFrame:
    """Add `target`: the file a specifier means, or null.

    Order: alias, relative path (as written, then with the source endings, then
    with its own ending swapped for one of them), exact project path, same file
    name anywhere (shortest path, then alphabetical). Each distinct (folder,
    specifier) is looked up once by hash join; nothing scans the file list.
    """
    df = _apply_aliases(imports, aliases).withColumn("_dir", folder(F.col("path")))
    spec = F.col("_spec")
    relative = spec.startswith("./") | spec.startswith("../")
    # A bare or rooted specifier means the same from every folder.
    df = df.withColumn("_dir", F.when(relative, F.col("_dir")).otherwise(""))
    wanted = df.select("_dir", "_spec").distinct()
    base = F.when(relative, joined(F.col("_dir"), spec)).when(
        spec.startswith("/"), F.substring(normalized(spec), F.lit(2), F.length(spec))).otherwise(spec)
    wanted = wanted.withColumn("_base", F.regexp_replace(base, "^/", ""))
    anchored = relative | spec.startswith("/")
    name = file_name(F.col("_base"))

    def key(space: str, value: Column, rank: int) -> Column:
        return F.struct(F.concat(F.lit(space + ":"), value).alias("key"), F.lit(rank).alias("how"))

    swapped = without_extension(F.col("_base"))
    keys = F.array(
        key("path", F.col("_base"), 0),
        F.when(anchored, key("stem", F.col("_base"), 1)),
        F.when(anchored & (swapped != F.col("_base")), key("stem", swapped, 2)),
        F.when(name != "", key("name", name, 4)),
    )
    lookups = wanted.select("_dir", "_spec", F.explode_outer(F.array_compact(keys)).alias("k")).select(
        "_dir", "_spec", "k.key", "k.how")
    path = F.col("path")
    stem = without_extension(path)
    ending = F.substring(path, F.length(stem) + 1, F.length(path))
    order = F.array_position(F.array(*[F.lit(e) for e in SOURCE_ENDINGS]), ending)
    entries = F.array(
        F.struct(F.concat(F.lit("path:"), path).alias("key"), F.lit(0).cast("bigint").alias("rank")),
        F.when(order > 1, F.struct(F.concat(F.lit("stem:"), stem).alias("key"), order.alias("rank"))),
        F.struct(F.concat(F.lit("name:"), file_name(path)).alias("key"), F.length(path).cast("bigint").alias("rank")),
    )
    index = files.select("path").select(F.explode_outer(F.array_compact(entries)).alias("e"), "path").groupBy(
        F.col("e.key").alias("key")).agg(F.min(F.struct(F.col("e.rank").alias("rank"), path.alias("path"))).alias("hit"))
    best = lookups.join(index, "key").groupBy("_dir", "_spec").agg(
        F.min_by("hit.path", "how").alias("target"))
    return df.join(best, ["_dir", "_spec"], "left").drop("_dir", "_spec")


def edges_of(resolved: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs of resolved imports."""
    return resolved.filter(F.col("target").isNotNull()).select(
        F.col("path").alias("src"), F.col("target").alias("dst")).distinct()


def is_external(module: Column, language: Column | None = None) -> Column:
    """Not relative, not absolute, not below `src/`; leading dots in Python and the crate's own roots in Rust are relative too."""
    inside = module.startswith("./") | module.startswith("../") | module.startswith("/") | module.startswith("src/")
    if language is not None:
        inside = inside | F.coalesce((language == "python") & module.startswith("."), F.lit(False)) | F.coalesce(
            (language == "rust") & F.substring_index(module, "::", 1).isin("crate", "self", "super"), F.lit(False))
    return ~inside


def package_name(module: Column, language: Column | None = None) -> Column:
    """`@scope/pkg`, `host.tld/org/repo`, in Rust what stands before `::`, else the first segment."""
    rust = F.lit(False) if language is None else language == "rust"
    return (
        F.when(rust, F.substring_index(module, "::", 1))
        .when(module.startswith("@"), F.substring_index(module, "/", 2))
        .when(module.contains(".") & (F.size(F.split(module, "/")) >= 3), F.substring_index(module, "/", 3))
        .otherwise(F.substring_index(module, "/", 1))
    )


def unresolved_references(resolved: DataFrame) -> DataFrame:
    """Imports and links that should hit a file of the corpus and do not."""
    return resolved.filter(F.col("target").isNull() & ~is_external(F.col("module_path"))).select(
        "path", "module_path", "line")


def unresolved_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links whose target is not in `targets(target)`."""
    return links.join(targets.select("target").distinct(), "target", "left_anti")


def external_dependencies(imports: DataFrame) -> DataFrame:
    """Files and uses per external package, counted per file first."""
    outside = imports.filter(is_external(F.col("module_path"), F.col("language")))
    per_file = outside.groupBy(package_name(F.col("module_path"), F.col("language")).alias("package"), "path").agg(
        F.count("*").alias("n"))
    return per_file.groupBy("package").agg(F.count("*").alias("files"), F.sum("n").alias("imports"))
