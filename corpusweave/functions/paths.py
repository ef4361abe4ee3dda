"""Path expressions on `/`-separated strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """Everything before the last `/`, empty for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty for none and for dot files."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def normalized(path: Column) -> Column:
    """Resolve `.` and `..`, drop empty segments; leading `..` beyond the root stay."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(
            (p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        ).otherwise(F.concat(done, F.array(p))),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(folded, "/"))


def joined(base: Column, relative: Column) -> Column:
    return normalized(F.concat(base, F.lit("/"), relative))


def relative(from_folder: Column, to_path: Column) -> Column:
    """Path of `to_path` as seen from `from_folder` (both normalized)."""
    a = F.when(from_folder == "", F.array().cast("array<string>")).otherwise(
        F.split(from_folder, "/")
    )

    def climb(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        differs = F.array_position(same, False).cast("int")
        shared = F.when(differs > 0, differs - 1).otherwise(F.size(a))
        ups = F.array_repeat(F.lit(".."), F.size(a) - shared)
        return F.concat(ups, F.slice(b, shared + 1, F.greatest(F.size(b) - shared, F.lit(0))))

    return F.array_join(bind(a, lambda x: bind(F.split(to_path, "/"), lambda y: climb(x, y))), "/")


def ancestors(path: Column) -> Column:
    """All folders above a path: `a/b/c.ts` gives `a`, `a/b`."""
    none = F.array().cast("array<string>")
    return bind(F.split(path, "/"), lambda parts: F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(none))
