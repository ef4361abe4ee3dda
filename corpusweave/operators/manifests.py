"""Dependency tables from manifests, and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import file_name, folder
from ..functions.text import bind, lines_of, running

# Dependency sections of a package.json.
PACKAGE_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
# Dependency sections of a Cargo.toml.
CARGO_SECTIONS = ["dependencies", "dev-dependencies", "build-dependencies"]


def manifest_kind(path: Column) -> Column:
    """By file name: cargo, package_json, pyproject, requirements, or null."""
    name = F.lower(file_name(path))
    return (
        F.when(name.endswith("cargo.toml"), "cargo").when(name.endswith("package.json"), "package_json")
        .when(name.endswith("pyproject.toml"), "pyproject").when(name.rlike(r"^requirements.*\.txt$"), "requirements"))


def _unreadable(df: DataFrame, manifest: Column, error: Column) -> DataFrame:
    """One row for each manifest with an error, in the shape of dependency rows."""
    empty = lambda kind: F.lit(None).cast(kind)
    return df.filter(error.isNotNull()).select(
        manifest.alias("manifest"), *[empty("string").alias(c) for c in ("pkg", "section", "name", "spec")],
        F.array().cast("array<string>").alias("features"), F.lit(False).alias("optional"), empty("bigint").alias("position"), error.alias("error"))


def _package_json(files: DataFrame) -> DataFrame:
    fields = ", ".join(f"{s} map<string,string>" for s in PACKAGE_SECTIONS)
    read = F.from_json("content", f"name string, {fields}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    df = files.select(F.col("path").alias("manifest"), read.alias("j"))
    error = F.when(F.col("j").isNull() | F.col("j._bad").isNotNull(), "not a JSON object with tables of dependencies")

    def section(name: str) -> Column:
        none = F.array().cast("array<struct<key:string,value:string>>")
        return F.transform(F.coalesce(F.map_entries(F.col(f"j.{name}")), none), lambda e: F.struct(
            F.lit(name).alias("section"), e["key"].alias("name"), e["value"].alias("spec")))

    entries = F.flatten(F.array(*[section(s) for s in PACKAGE_SECTIONS]))
    rows = df.filter(error.isNull()).select("manifest", F.col("j.name").alias("pkg"), F.posexplode_outer(entries).alias("position", "d")).filter(
        "d is not null")
    return rows.select(
        "manifest", "pkg", "d.section", "d.name", "d.spec", F.array().cast("array<string>").alias("features"),
        F.lit(False).alias("optional"), F.col("position").cast("bigint").alias("position"), F.lit(None).cast("string").alias("error")).unionByName(
            _unreadable(df, F.col("manifest"), error))


def _requirements(files: DataFrame) -> DataFrame:
    lines = files.select(F.col("path").alias("manifest"), F.posexplode_outer(lines_of(F.col("content"))).alias("position", "line"))
    line = F.trim(F.col("line"))
    lines = lines.withColumn("_l", F.regexp_replace(line, r"^([^\[]*)\[[^\]]*\]", "$1")).filter(
        (line != "") & ~line.startswith("#"))
    # Separators are tried in this order, whichever comes first in the line.
    name, spec = F.col("_l"), F.lit("*")
    for sep in reversed(["==", ">=", "<=", "~=", ">", "<", "!="]):
        has = F.col("_l").contains(sep)
        at = F.instr("_l", sep)
        name = F.when(has, F.substring("_l", F.lit(1), at - 1)).otherwise(name)
        spec = F.when(has, F.trim(F.substring("_l", at + len(sep), F.length("_l")))).otherwise(spec)
    extras = F.split(F.regexp_extract(line, r"^[^\[]*\[([^\]]*)\]", 1), r"\s*,\s*")
    return lines.select(
        "manifest", file_name(folder(F.col("manifest"))).alias("pkg"), F.lit("dependencies").alias("section"),
        F.trim(name).alias("name"), spec.alias("spec"), F.filter(extras, lambda x: x != "").alias("features"),
        F.lit(False).alias("optional"), F.col("position").cast("bigint").alias("position"), F.lit(None).cast("string").alias("error"))


_STRING = r'''(?:"""(?:[^"\\]|\\.|"(?!""))*+"""|\'\'\'(?:[^']|'(?!\'\'))*+\'\'\'|"(?:[^"\\\n]|\\.)*+"|'[^'\n]*+')'''
_COMMENT = r"#[^\n]*+"
_LIST = rf"\[(?:[^\[\]\"'#]|{_STRING}|{_COMMENT}|\[(?:[^\[\]\"'#]|{_STRING}|{_COMMENT})*+\]|\{{[^{{}}]*+\}})*+\]"
_TABLE = rf"\{{(?:[^{{}}\"'\n]|{_STRING}|\{{[^{{}}\n]*+\}})*+\}}"
_NAME = rf"(?:[\w-]++|{_STRING})"
_KEY = rf"{_NAME}(?:[ \t]*+\.[ \t]*+{_NAME})*+"
#: What ends a header or a value: blanks and a comment up to the end of the line.
_REST = rf"(?=[ \t]*+(?:{_COMMENT})?+(?:\r?\n|\z))"
_HEADER = rf"\[\[?+[ \t]*+{_KEY}[ \t]*+\]\]?+{_REST}"
_PAIR = rf"{_KEY}[ \t]*+=[ \t]*+(?:{_STRING}|{_LIST}|{_TABLE}|[\w.+:-]++){_REST}"
_TOML = rf"(?s)(?:\s++|{_COMMENT}|{_HEADER}|{_PAIR}|[^\n]++)"


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"""(?s)^(?:\"\"\"|'''|["'])|(?:\"\"\"|'''|["'])$""", "")


def _segments(key: Column) -> Column:
    return F.transform(F.regexp_extract_all(key, F.lit(rf"(?s){_NAME}"), F.lit(0)), _unquoted)


def _strings(text: Column) -> Column:
    """Strings of a list, without comments."""
    bare = F.regexp_replace(text, rf"(?s)({_STRING})|{_COMMENT}", "$1")
    return F.transform(F.regexp_extract_all(bare, F.lit(rf"(?s){_STRING}"), F.lit(0)), _unquoted)


def _toml_entries(files: DataFrame) -> DataFrame:
    """manifest, position, path (segments of section and key) and value of each pair of TOML texts; `error` names the first line that is neither.

    One lexical pass cuts a text into comments, headers and pairs, whose values may run over lines; the section is the last header before.
    """
    def of(tokens: Column) -> Column:
        is_header, is_pair = (lambda t: t.rlike(rf"(?s)^{_HEADER[:-len(_REST)]}$")), (lambda t: t.rlike(rf"(?s)^{_PAIR[:-len(_REST)]}$"))
        heads = running(F.transform(tokens, lambda t: F.when(is_header(t), t)), F.lit(None).cast("string"), lambda carry, x: F.coalesce(x, carry), "string")

        def entry(heads: Column, t: Column, i: Column) -> Column:
            key = F.regexp_extract(t, rf"(?s)^({_KEY})", 1)
            section = F.regexp_replace(F.coalesce(F.get(heads, i), F.lit("")), r"^\[\[?+|\]\]?+$", "")
            value = F.regexp_extract(t, rf"(?s)^{_KEY}[ \t]*+=[ \t]*+(.*)$", 1)
            blank = t.rlike(r"(?s)^(?:\s|#)")
            return F.struct(
                i.cast("bigint").alias("position"), F.when(is_pair(t), F.concat(_segments(section), _segments(key))).alias("path"),
                F.trim(value).alias("value"), F.when(~blank & ~is_header(t) & ~is_pair(t), F.concat(F.lit("cannot be read: "), F.trim(t))).alias("error"))

        return bind(heads, lambda h: F.filter(F.transform(tokens, lambda t, i: entry(h, t, i)), lambda e: e["path"].isNotNull() | e["error"].isNotNull()))

    tokens = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(_TOML), F.lit(0))
    rows = files.select(F.col("path").alias("manifest"), bind(tokens, of).alias("entries"))
    first = F.get(F.filter("entries", lambda e: e["error"].isNotNull()), F.lit(0))["error"]
    return rows.withColumn("error", first)


def _placed_dependency(path: Column) -> Column:
    """struct<section, name, detail> of a pair that says something of a dependency, else null; `detail` is null for the dependency itself."""
    part = lambda n: F.get(path, F.lit(n))
    made = lambda section, n: F.struct(section.alias("section"), part(n).alias("name"), part(n + 1).alias("detail"))
    cargo = lambda n: part(n).isin(*CARGO_SECTIONS)
    poetry = (part(0) == "tool") & (part(1) == "poetry")
    return (
        F.when(cargo(0), made(part(0), 1))
        .when((part(0) == "target") & cargo(2), made(F.concat(F.lit("target."), part(1), F.lit("."), part(2)), 3))
        .when((part(0) == "workspace") & (part(1) == "dependencies"), made(F.lit("workspace.dependencies"), 2))
        .when(poetry & part(2).isin("dependencies", "dev-dependencies"), made(part(2), 3))
        .when(poetry & (part(2) == "group") & (part(4) == "dependencies"), made(F.concat(F.lit("group."), part(3)), 5)))


def _listed_section(path: Column) -> Column:
    """Section of a list of requirements, else null."""
    part = lambda n: F.get(path, F.lit(n))
    size = F.size(path)
    return (
        F.when((part(0) == "project") & (part(1) == "dependencies") & (size == 2), "dependencies")
        .when((part(0) == "project") & (part(1) == "optional-dependencies") & (size == 3), F.concat(F.lit("optional."), part(2)))
        .when((part(0) == "tool") & (part(1) == "pdm") & (part(2) == "dev-dependencies") & (size == 4), F.concat(F.lit("dev."), part(3))))


def _toml(files: DataFrame) -> DataFrame:
    parsed = _toml_entries(files)
    named = F.transform(F.array(F.lit("package"), F.lit("project"), F.lit("tool.poetry")), lambda s: F.get(F.filter(
        "entries", lambda e: F.array_join(e["path"], ".") == F.concat(s, F.lit(".name"))), F.lit(0))["value"])
    pkg = _unquoted(F.get(F.array_compact(named), F.lit(0)))
    entries = parsed.select("manifest", pkg.alias("pkg"), "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("entries"))).alias("e")).select(
        "manifest", "pkg", "error", "e.position", "e.path", "e.value").withColumn("d", _placed_dependency(F.col("path"))).withColumn("listed", _listed_section(F.col("path")))
    # A dependency may be one string or table, a table of its own, or dotted keys: all become (key, value) details.
    inner = F.regexp_extract_all("value", F.lit(rf"(?s)[\w-]++[ \t]*+=[ \t]*+(?:{_STRING}|\[[^\[\]]*+\]|\w++)"), F.lit(0))
    detail = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    of_table = F.transform(inner, lambda x: detail(F.trim(F.substring_index(x, "=", 1)), F.trim(F.regexp_replace(x, r"(?s)^[^=]*+=", ""))))
    details = (
        F.when(F.col("d.detail").isNotNull(), F.array(detail(F.col("d.detail"), F.col("value"))))
        .when(F.col("value").startswith("{"), of_table).otherwise(F.array(detail(F.lit("version"), F.col("value")))))

    def item(section: Column, name: Column, position: Column, place: Column, spec: Column, optional: Column, details: Column) -> Column:
        return F.struct(section.alias("section"), name.alias("name"), position.alias("position"), place.cast("bigint").alias("place"),
                        spec.cast("string").alias("spec"), optional.alias("optional"), details.cast("array<struct<key:string,value:string>>").alias("details"))

    def listed(text: Column, place: Column) -> Column:
        name = F.regexp_extract(text, r"^([^=<>~!; \[]*)", 1)
        spec = F.coalesce(F.nullif(F.trim(F.substring(text, F.length(name) + 1, F.length(text))), F.lit("")), F.lit("*"))
        at = F.col("position") + place
        return item(F.col("listed"), F.trim(name), at, at, spec, F.col("listed") != "dependencies", F.array())

    tabled = item(F.col("d.section"), F.col("d.name"), F.col("position"), F.lit(None), F.lit(None), F.lit(False), details)
    items = F.when(F.col("d.name").isNotNull(), F.array(tabled)).when(F.col("listed").isNotNull(), F.transform(_strings(F.col("value")), listed))
    rows = entries.select("manifest", "pkg", "error", F.explode_outer(items).alias("i")).filter("i is not null or error is not null").select("manifest", "pkg", "error", "i.*")
    each = rows.groupBy("manifest", "pkg", "error", "section", "name", "place").agg(
        F.min("position").alias("position"), F.min("spec").alias("given"), F.max("optional").alias("may"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "details"))), lambda x: x["details"])).alias("details"))
    of = lambda key: F.get(F.filter("details", lambda x: x["key"] == key), F.lit(0))["value"]
    spec = F.coalesce("given", F.concat(F.lit("git:"), _unquoted(of("git"))), F.concat(F.lit("path:"), _unquoted(of("path"))), _unquoted(of("version")), F.lit("*"))
    # Positions count from 0 in the order of the text.
    order = F.row_number().over(Window.partitionBy("manifest").orderBy("position", "section", "name")).cast("bigint") - 1
    fine = F.col("error").isNull()
    return each.select(
        "manifest", F.when(fine, F.col("pkg")).alias("pkg"), "section", "name", F.when(fine, spec).alias("spec"),
        F.coalesce(_strings(of("features")), F.array().cast("array<string>")).alias("features"),
        (F.coalesce("may", F.lit(False)) | F.coalesce(of("optional") == "true", F.lit(False))).alias("optional"), F.when(fine, order).alias("position"), "error")


def read_manifests(files: DataFrame) -> DataFrame:
    """Dependency rows of package.json, requirements.txt, Cargo.toml and pyproject.toml files.

    Cargo's tables for targets and workspaces count, and so do Poetry's groups and lists of requirements. A manifest that cannot be read
    gives one row with an `error` and no dependencies; for all other rows `error` is null.
    """
    df = files.select("path", "content", manifest_kind(F.col("path")).alias("kind")).filter("kind is not null")
    return (
        _package_json(df.filter(F.col("kind") == "package_json"))
        .unionByName(_requirements(df.filter(F.col("kind") == "requirements")))
        .unionByName(_toml(df.filter(F.col("kind").isin("cargo", "pyproject")))))


def classify_specs(dependencies: DataFrame) -> DataFrame:
    """Add source kind (git, path, version), bare and x.y.z version, any-version and range flags."""
    spec = F.trim(F.col("spec"))
    git = spec.rlike(r"^(?:git\+|git@|github:|gitlab:|bitbucket:)") | spec.contains(".git")
    path = spec.rlike(r"^(?:\./|\.\./|file:|/|https?://)")
    bare = F.trim(F.regexp_replace(spec, r"^\^*~*(?:>=)*(?:<=)*>*<*=*", ""))
    parts = F.slice(F.split(bare, r"\."), 1, 3)
    dotted = F.array_join(F.slice(F.concat(parts, F.array(F.lit("0"), F.lit("0"))), F.lit(1), F.lit(3)), ".")
    url = F.regexp_replace(F.substring_index(spec, "#", 1), r"^(?:git\+)+", "")
    kind = F.when(git, "git").when(path, "path").otherwise("version")
    return (
        dependencies.withColumn("source_kind", kind)
        .withColumn("version", bare)
        .withColumn("normalized_version", dotted)
        .withColumn("git_url", F.when(git, url))
        .withColumn("git_rev", F.when(git & spec.contains("#"), F.regexp_extract(spec, r"#(.*)$", 1)))
        .withColumn("any_version", spec.isin("*", "latest", "x", "X", ""))
        .withColumn("version_range", F.col("spec").rlike(r"\|\|| - |^[\^~<>]")))


def dedupe_dependencies(dependencies: DataFrame) -> DataFrame:
    """The first row per (manifest, section, name), by position; pre-aggregated per task."""
    others = [c for c in dependencies.columns if c not in ("manifest", "section", "name", "position")]
    first = F.min(F.struct("position", *others)).alias("_f")
    df = dependencies.groupBy("manifest", "section", "name").agg(first)
    return df.select("manifest", "section", "name", "_f.*").select(*dependencies.columns)


def extract_dependencies(names: DataFrame, source: DataFrame, target: DataFrame, section: str = "dependencies") -> DataFrame:
    """Requested names against a source and a section of a target: added, already_exists or not_found."""
    found = source.groupBy("name").agg(F.min(F.struct("section", "position", "spec")).alias("s")).select(
        "name", F.col("s.section").alias("source_section"), F.col("s.spec").alias("spec"))
    present = target.filter(F.col("section") == section).select("name").distinct().withColumn("_there", F.lit(True))
    df = names.select("name").distinct().join(found, "name", "left").join(present, "name", "left")
    outcome = F.when(F.col("source_section").isNull(), "not_found").when(
        F.col("_there"), "already_exists").otherwise("added")
    return df.select("name", "source_section", "spec", outcome.alias("outcome"))


def merge_dependencies(source: DataFrame, target: DataFrame, target_pkg: str, skip: tuple[str, ...] = ("python",)) -> DataFrame:
    """Union per (section, name) in which the target wins; never a dependency on itself.

    `origin` says where a row comes from: target, merged, or conflict (in both).
    """
    side = lambda df, n: df.groupBy("section", "name").agg(
        F.min_by("spec", "position").alias(n))
    t, s = side(target, "_target"), side(source, "_source")
    joined = t.join(s, ["section", "name"], "full_outer")
    origin = F.when(F.col("_target").isNull(), "merged").when(F.col("_source").isNull(), "target").otherwise("conflict")
    incoming_only = F.col("_target").isNull()
    barred = incoming_only & ((F.col("name") == target_pkg) | F.col("name").isin(*skip))
    return joined.filter(~barred).select(
        "section", "name", F.coalesce("_target", "_source").alias("spec"), origin.alias("origin"))


def merge_counts(merged: DataFrame) -> DataFrame:
    """Merged and conflicting dependencies per section."""
    return merged.groupBy("section").agg(
        F.count_if(F.col("origin") == "merged").alias("merged"),
        F.count_if(F.col("origin") == "conflict").alias("conflicts"))


def update_members(members: DataFrame, requested: DataFrame, action: str = "add") -> DataFrame:
    """Workspace members (workspace, member, position) after `add`, `remove` or `list`.

    Old members keep their order, new ones follow in request order; the counts
    before and after come along.
    """
    if action not in ("add", "remove", "list"):
        raise ValueError(f"unknown action: {action!r}")
    old = members.select("workspace", "member", F.lit(0).alias("_new"), "position")
    if action == "add":
        asked = requested.select("workspace", "member", F.lit(1).alias("_new"), "position")
        both = old.unionByName(asked)
        rows = both.groupBy("workspace", "member").agg(F.min(F.struct("_new", "position")).alias("p"))
    else:
        kept = old
        if action == "remove":
            kept = old.join(requested.select("workspace", "member").distinct(), ["workspace", "member"], "left_anti")
        rows = kept.groupBy("workspace", "member").agg(F.min(F.struct("_new", "position")).alias("p"))
    before = members.select("workspace", "member").distinct().groupBy("workspace").agg(F.count("*").alias("before"))
    after = rows.groupBy("workspace").agg(F.count("*").alias("after"))
    return rows.select("workspace", "member", (F.col("p._new") == 1).alias("added"), F.col("p.position").alias("position")).join(
        after, "workspace").join(before, "workspace", "left").withColumn("before", F.coalesce("before", F.lit(0)).cast("bigint"))
