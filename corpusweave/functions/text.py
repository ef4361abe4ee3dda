"""Text and array expressions. All of them stay inside the JVM.

A note on `explode_outer`, used throughout: for a plain `explode` Spark adds a
filter that the array is not empty and pushes it down, which computes the array
a second time, and nested arrays once per level. The outer form computes it
once; a test for null behind it drops the rows of empty arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(literal: str) -> str:
    """A Java pattern that matches `literal` as it stands."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def lines_of(text: Column) -> Column:
    """Lines of a text: `\\r\\n` or `\\n` ends a line, a last empty line is no line."""
    whole = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(whole, r"\r?\n", -1)
    )


def occurrences(text: Column, piece: str) -> Column:
    """How often a fixed string occurs, left to right without overlaps."""
    shorter = F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))
    return (shorter / len(piece)).cast("bigint")


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(moment.cast("timestamp"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(
    values: Column, zero: Column, combine: Callable[[Column, Column], Column], kind: str = "bigint"
) -> Column:
    """Inclusive running combination of an array by an associative function.

    Works in blocks of about sqrt(n), because appending to an array copies it:
    one long fold would copy n*n/2 elements.
    """
    return bind(values, lambda v: bind(
        F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1)),
        lambda width: _running(v, width, zero, combine, kind)))


def _running(values: Column, width: Column, zero: Column, combine, kind: str) -> Column:
    size = F.size(values)
    empty = F.array().cast(f"array<{kind}>")

    def inside(block: Column) -> Column:
        return F.aggregate(
            block,
            empty,
            lambda done, x: F.concat(
                done, F.array(combine(F.coalesce(F.get(done, F.size(done) - 1), zero), x))
            ),
        )

    def merge(state: Column, block: Column) -> Column:
        carry = state["carry"]
        return F.struct(
            combine(carry, F.element_at(block, -1)).alias("carry"),
            F.concat(
                state["blocks"], F.array(F.transform(block, lambda x: combine(carry, x)))
            ).alias("blocks"),
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / width).cast("int")),
        lambda i: inside(F.slice(values, i * width + 1, width)),
    )
    start = F.struct(
        zero.cast(kind).alias("carry"),
        F.array().cast(f"array<array<{kind}>>").alias("blocks"),
    )
    folded = F.aggregate(blocks, start, merge, lambda s: F.flatten(s["blocks"]))
    return F.when(size == 0, empty).otherwise(folded)


def running_sum(values: Column) -> Column:
    return running(values, F.lit(0).cast("bigint"), lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))


def unescaped_quotes(text: Column, quote: str) -> Column:
    """Number of `quote` characters not preceded by an odd run of backslashes."""
    bare = F.regexp_replace(text, r"\\.", "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(quote), F.lit("")))


def glob_regex(pattern: str) -> str:
    """Java regex for a path glob: `**` crosses folders, `*` and `?` do not, `{a,b}` chooses."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"invalid glob: {pattern!r}")
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append("\\" + c if c in ".()+^$|\\]}" else c)
        i += 1
    if depth:
        raise ValueError(f"invalid glob: {pattern!r}")
    return "^" + "".join(out) + "$"
