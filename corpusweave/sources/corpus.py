"""Reading, scoping, gating, splitting and writing a corpus of files."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import pattern_language_of
from ..functions.paths import extension, file_name
from ..functions.text import glob_regex, lines_of

# Folders that are never part of a corpus.
EXCLUDED_FOLDERS = [
    "target", "node_modules", ".git", "build", "dist", ".svelte-kit", ".next", ".output",
    "coverage", ".turbo",
]
# Extensions of files that hold no text.
BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "ico", "webp", "avif", "svg", "bmp",
    "woff", "woff2", "ttf", "otf", "eot",
    "zip", "tar", "gz", "rar", "7z",
    "mp3", "mp4", "webm", "wav", "avi", "mov",
    "glb", "pdf", "exe", "dll", "so", "dylib", "wasm",
]
# Files that tools generate and nobody edits.
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock"]


def in_excluded_folder(path: Column) -> Column:
    names = "|".join(name.replace(".", "\\.") for name in EXCLUDED_FOLDERS)
    return path.rlike(f"(?:^|/)(?:{names})/")


def is_excluded_file(path: Column) -> Column:
    return F.lower(extension(path)).isin(*BINARY_EXTENSIONS) | file_name(path).isin(*LOCK_FILES)


def path_filter(
    path: Column, include: Iterable[str] = (), exclude: Iterable[str] = (), defaults: bool = True
) -> Column:
    """Include and exclude globs as one predicate; a bad glob raises ValueError here."""
    keep = F.lit(True)
    for pattern in exclude:
        keep = keep & ~path.rlike(glob_regex(pattern))
    wanted = [path.rlike(glob_regex(pattern)) for pattern in include]
    if wanted:
        some = wanted[0]
        for other in wanted[1:]:
            some = some | other
        keep = keep & some
    if defaults:
        keep = keep & ~in_excluded_folder(path) & ~is_excluded_file(path)
    return keep


def as_files(df: DataFrame) -> DataFrame:
    """Fill in the derived columns of a (path, content[, modified_at]) table."""
    out = df
    if "modified_at" not in df.columns:
        out = out.withColumn("modified_at", F.lit(None).cast("timestamp"))
    if "size_bytes" not in df.columns:
        out = out.withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    return out.select(
        "path",
        extension(F.col("path")).alias("ext"),
        pattern_language_of(F.col("path")).alias("language"),
        "content",
        "size_bytes",
        "modified_at",
        F.sha2(F.col("content"), 256).alias("sha256"),
    )


def _qualified(spark: SparkSession, location: str) -> str:
    """A folder as the file listing spells it, with scheme and a last slash."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString().rstrip("/") + "/"


def read_corpus(
    spark: SparkSession,
    location: str,
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    defaults: bool = True,
    format: str = "binaryFile",
) -> DataFrame:
    """Files below a folder, or a stored (path, content) table of any Spark format.

    For folders the globs prune the list of files, so that excluded files are not
    opened; paths come out relative to the folder.
    """
    if format != "binaryFile":
        table = spark.read.format(format).load(location)
        return as_files(table.filter(path_filter(F.col("path"), include, exclude, defaults)))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    # Cut once, from the left: the folder's name may come again below it.
    skipped = F.lit(len(_qualified(spark, location)) + 1)
    below = lambda path: F.substring(path, skipped, F.length(path))
    listed = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    files = raw.filter(path_filter(below(listed), include, exclude, defaults)).withColumn("path", below(F.col("path")))
    return as_files(
        files.select(
            "path",
            F.decode(F.col("content"), "UTF-8").alias("content"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified_at"),
        )
    )


def list_files(files: DataFrame, directory: str = "", recursive: bool = True,
               pattern: str | None = None) -> DataFrame:
    """Paths below a directory, optionally only its direct children or a glob."""
    prefix = directory.rstrip("/") + "/" if directory else ""
    below = files.filter(F.col("path").startswith(prefix)).select(
        F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path")).alias("path"))
    if not recursive:
        below = below.select(F.substring_index("path", "/", 1).alias("path")).distinct()
    if pattern:
        below = below.filter(F.col("path").rlike(glob_regex(pattern)))
    return below


@dataclass(frozen=True)
class Scope:
    """Which kinds of file an operation may touch."""

    code: bool = True
    docs: bool = True
    configs: bool = True
    ignore_files: bool = True
    comments: bool = False
    prose: bool = False
    exclude: tuple[str, ...] = field(default_factory=tuple)

    @staticmethod
    def preset(name: str, exclude: Iterable[str] = ()) -> "Scope":
        kept = tuple(exclude)
        if name == "code":
            return Scope(docs=False, configs=False, ignore_files=False, exclude=kept)
        if name == "standard":
            return Scope(exclude=kept)
        if name == "comments":
            return Scope(comments=True, exclude=kept)
        if name == "everything":
            return Scope(comments=True, prose=True, exclude=kept)
        raise ValueError(f"unknown scope preset: {name!r}")

    def predicate(self, path: Column) -> Column:
        ext = extension(path)
        kind = (
            F.when(file_name(path) == ".gitignore", F.lit(self.ignore_files))
            .when(ext.isin("md", "markdown"), F.lit(self.docs))
            .when(ext.isin("toml", "yaml", "yml"), F.lit(self.configs))
            .when(ext.isin("rs", "ts", "tsx", "js", "jsx"), F.lit(self.code))
            .otherwise(F.lit(True))
        )
        return kind & path_filter(path, exclude=self.exclude, defaults=False)


def apply_scope(files: DataFrame, scope: Scope | str = "standard") -> DataFrame:
    """Keep the files a scope covers; unknown extensions stay."""
    chosen = Scope.preset(scope) if isinstance(scope, str) else scope
    return files.filter(chosen.predicate(F.col("path")))


def is_text(content: Column, path: Column) -> Column:
    """No known binary extension, and under 5% control characters in the whole text."""
    controls = F.regexp_count(content, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\uFFFD]"))
    return ~F.lower(extension(path)).isin(*BINARY_EXTENSIONS) & (controls.cast("bigint") * 20 < F.length(content))


def text_gate(files: DataFrame) -> DataFrame:
    return files.filter(is_text(F.col("content"), F.col("path")))


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 0, without line endings."""
    return files.select(
        "path", F.posexplode_outer(lines_of(F.col("content"))).alias("line_no", "line")
    ).filter("line is not null")


def write_rewritten(df: DataFrame, path: str, dry_run: bool = True,
                    format: str = "parquet") -> DataFrame:
    """Rows (path, content, new_content) that changed; written to a new folder unless dry.

    The folder must not exist: an input still being read is never overwritten.
    """
    changed = df.filter(F.col("content") != F.col("new_content"))
    if not dry_run:
        changed.select("path", F.col("new_content").alias("content")).write.mode(
            "errorifexists"
        ).format(format).save(path)
    return changed.select("path", "content", "new_content")
