"""Repeated runs of tokens across files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Odd multipliers of the two hashes, and tokens hashed at a time.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_CHUNK = 1 << 20
_ANCHORS = "array<struct<anchor:bigint,first:int,last:int>>"
_HASHES = "array<struct<position:bigint,h1:bigint,h2:bigint>>"


class _Tokens:
    """Token numbers of some texts laid end to end."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray):
        self.numbers, self.n = numbers.view(np.uint64), len(numbers)
        self.begins = np.cumsum(counts) - counts
        self.left = np.repeat(self.begins + counts, counts) - np.arange(self.n)
        self.place = np.arange(self.n) - np.repeat(self.begins, counts)

    def hashes(self, starts: np.ndarray, size: int, base: int) -> np.ndarray:
        """Hash of the `size` tokens from each start: a difference of running sums, shifted back to its start."""
        values = self.numbers if base == _BASES[0] else (self.numbers ^ (self.numbers >> np.uint64(31))) * np.uint64(base)
        one = np.ones(1, np.uint64)
        powers = np.cumprod(np.concatenate([one, np.full(self.n, base, np.uint64)]))
        back = np.cumprod(np.concatenate([one, np.full(self.n, pow(base, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:-1], dtype=np.uint64)])
        found = (sums[starts + size] - sums[starts]) * back[starts]
        return found ^ (found >> np.uint64(29))

    def starts(self, size: int) -> np.ndarray:
        return np.flatnonzero(self.left >= size)

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first and last window of every anchor: of the short runs in a window the one with the least hash.

        Equal windows have equal anchors at the same distance from their starts.
        """
        short = (size + 1) // 2
        wide = size - short + 1
        starts = self.starts(size)
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3
        at = self.starts(short)
        value = np.full(self.n, np.iinfo(np.uint64).max)
        value[at] = self.hashes(at, short, _BASES[0]) * np.uint64(_BASES[1])
        least, reach = np.arange(self.n), 1
        while reach < wide:
            step = min(reach, wide - reach)
            later = least[np.minimum(np.arange(self.n) + step, self.n - 1)]
            least, reach = np.where(value[later] < value[least], later, least), reach + step
        chosen = least[starts]
        new = np.flatnonzero(np.diff(chosen, prepend=-1))
        ends = np.append(new[1:], len(chosen)) - 1
        return value[chosen[new]].view(np.int64), starts[new], starts[ends]


def _chunks(lists: pa.Array):
    """Texts as (first row, counts, numbers), of about `_CHUNK` tokens each."""
    counts = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.asarray(lists.flatten())
    ends = np.cumsum(counts)
    row = 0
    while row < len(counts):
        done = ends[row] - counts[row]
        stop = max(row + 1, int(np.searchsorted(ends, done + _CHUNK, side="right")))
        yield row, counts[row:stop], flat[done : ends[stop - 1]]
        row = stop


def _listed(rows: list[np.ndarray], columns: list[list[np.ndarray]], names: list[str], types: list[pa.DataType]) -> pa.Array:
    """Lists of structs out of the number of items per row and their fields."""
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([*rows, np.zeros(0, np.int64)]))])
    fields = [pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names))


def _anchors(numbers: Column, size: int) -> Column:
    def found(lists: pa.Array) -> pa.Array:
        rows, columns = [], [[], [], []]
        for _, counts, flat in _chunks(lists):
            tokens = _Tokens(flat, counts)
            value, first, last = tokens.anchors(size)
            rows.append(np.bincount(np.searchsorted(tokens.begins, first, side="right") - 1, minlength=len(counts)))
            for column, items in zip(columns, (value, tokens.place[first], tokens.place[last])):
                column.append(items)
        return _listed(rows, columns, ["anchor", "first", "last"], [pa.int64(), pa.int32(), pa.int32()])

    return F.arrow_udf(found, _ANCHORS)(numbers)


def _hashes(numbers: Column, firsts: Column, lasts: Column, size: int) -> Column:
    def found(lists: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        rows, columns = [], [[], [], []]
        spans = np.asarray(first.value_lengths().fill_null(0)).astype(np.int64)
        begin, end, at = np.asarray(first.flatten()), np.asarray(last.flatten()), np.cumsum(spans) - spans
        for row, counts, flat in _chunks(lists):
            tokens = _Tokens(flat, counts)
            within = slice(at[row], at[row + len(counts) - 1] + spans[row + len(counts) - 1])
            shift = np.repeat(tokens.begins, spans[row : row + len(counts)])
            change = np.zeros(tokens.n + 1, np.int32)
            # Spans of another row of the same path may reach too far here: windows past the text's end are no starts.
            np.add.at(change, np.minimum(begin[within] + shift, tokens.n), 1)
            np.add.at(change, np.minimum(end[within] + shift + 1, tokens.n), -1)
            wanted = (np.cumsum(change[:-1]) > 0) & (tokens.left >= size)
            starts = np.flatnonzero(wanted)
            rows.append(np.bincount(np.searchsorted(tokens.begins, starts, side="right") - 1, minlength=len(counts)))
            for column, items in zip(columns, (tokens.place[starts], *(tokens.hashes(starts, size, b).view(np.int64) for b in _BASES))):
                column.append(items)
        return _listed(rows, columns, ["position", "h1", "h2"], [pa.int64()] * 3)

    return F.arrow_udf(found, _HASHES)(numbers, firsts, lasts)


def _windows(files: DataFrame, size: int) -> DataFrame:
    """(path, position, hash pair) of the runs of `size` tokens that may occur in several places.

    128 bits of hash stand for the run, so the tokens do not travel. Runs choose a
    shorter run inside them as an anchor, the same one wherever they stand; anchors are far fewer
    than runs, and only runs whose anchor occurs in several places are hashed and given.
    """
    tokens = F.filter(F.split("content", r"\s+"), lambda t: t != "")
    # Tokens become numbers once; a window then hashes numbers, not texts.
    numbers = F.transform(tokens, lambda t: F.xxhash64(t))
    anchors = files.select("path", F.explode_outer(_anchors(numbers, size)).alias("a")).filter("a is not null").select("path", "a.*")
    again = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    spans = anchors.join(again.hint("merge"), "anchor", "left_semi").groupBy(F.col("path").alias("_path")).agg(
        F.collect_list(F.struct("first", "last")).alias("_spans"))
    df = files.select("path", "content").join(spans.hint("merge"), F.col("path").eqNullSafe(F.col("_path")))
    hashed = _hashes(numbers, F.col("_spans.first"), F.col("_spans.last"), size)
    return df.select("path", F.explode_outer(hashed).alias("h")).filter("h is not null").select("path", "h.*")


def clone_windows(files: DataFrame, min_tokens: int = 50) -> DataFrame:
    """Runs of exactly `min_tokens` tokens that occur in several places.

    Occurrences are counted, not listed: copies of one text that fill a third
    of the corpus are one pre-aggregated row with its first place.
    """
    windows = _windows(files, min_tokens)
    return windows.groupBy("h1", "h2").agg(
        F.count("*").alias("places"), F.min(F.struct("path", "position")).alias("first")).filter("places > 1")


def clone_groups(files: DataFrame, min_tokens: int = 50) -> DataFrame:
    """Maximal runs of repeated tokens per file: first token, length in tokens, places.

    Neighbouring windows merge while each of them occurs elsewhere; `places` is
    the largest number of places any window of the run has.
    """
    repeated = clone_windows(files, min_tokens).select("h1", "h2", "places")
    hits = _windows(files, min_tokens).join(repeated, ["h1", "h2"])
    w = Window.partitionBy("path").orderBy("position")
    islands = hits.withColumn("_island", F.col("position") - F.row_number().over(w))
    return islands.groupBy("path", "_island").agg(
        F.min("position").alias("start_token"),
        (F.count("*") + min_tokens - 1).alias("tokens"), F.max("places").alias("places")).drop("_island")
