"""File changes as a stream: throttling, write batches, index upkeep, rewriting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.ordered import Ordered
from ..functions.text import micros
from ..operators.imports import edges_of, extract_imports, resolve_imports
from ..operators.rewrite import replaced_text
from ..operators.snapshots import incremental_reindex


def throttled_changes(changes: DataFrame, every: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Changes (project, path, ts): one row per project, window and distinct path.

    A project refreshes once per window, with these paths. Paths stay rows, so
    a project that changes everywhere at once is spread over tasks.
    """
    df = changes.withWatermark("ts", delay) if changes.isStreaming else changes
    return df.groupBy(F.window("ts", every).alias("w"), "project", "path").agg(F.count("*").alias("changes")).select(
        F.col("w.start").alias("refresh_start"), F.col("w.end").alias("refresh_end"), "project", "path", "changes")


def batched_writes(operations: DataFrame, gap_s: int = 600) -> DataFrame:
    """Write units per file: operations with at most `gap_s` seconds between them, in order.

    One row per operation with its unit and place in it. Ranges of the sorted
    operations are numbered apart and then joined up, so a file with a third of
    all operations does not end in one task.
    """
    rows = Ordered(operations, ["path"], ["created_at", "op_id"]).previous("_prev", F.col("created_at"))
    waited = micros(F.col("created_at")) - micros(F.col("_prev"))
    opens = F.when(F.col("_prev").isNull() | (waited >= gap_s * 1_000_000), 1).otherwise(0).cast("bigint")
    rows.running_sum({"unit": opens})
    units = Ordered(rows.result().drop("_prev"), ["path", "unit"], ["created_at", "op_id"]).row_number("position")
    return units.result()


def batched_write_units(operations: DataFrame, gap_s: int = 600, delay: str = "10 minutes") -> DataFrame:
    """Summary of each write unit; session windows on a stream, numbered units in batch.

    Session windows put a file's operations into one task, so the batch form
    builds on `batched_writes` instead.
    """
    order = F.struct("created_at", "op_id")
    measures = [F.count("*").alias("operations"), F.min_by("op_id", order).alias("first_op"),
                F.max_by("op_id", order).alias("last_op")]
    if operations.isStreaming:
        windowed = operations.withWatermark("created_at", delay).groupBy(
            F.session_window("created_at", f"{gap_s} seconds").alias("w"), "path").agg(*measures)
        return windowed.select("path", F.col("w.start").alias("unit_start"), F.col("w.end").alias("unit_end"),
                               "operations", "first_op", "last_op")
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_s))
    units = batched_writes(operations, gap_s).groupBy("path", "unit").agg(
        F.min("created_at").alias("unit_start"), (F.max("created_at") + gap).alias("unit_end"), *measures)
    return units.drop("unit")


def stream_find_replace(files: DataFrame, pattern: str, replacement: str, **options) -> DataFrame:
    """Rewritten text of arriving files; a stateless projection, as in batch."""
    return files.withColumn("new_content", replaced_text(F.col("content"), pattern, replacement, **options))


def new_versions(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each version (path, sha256, modified_at) once, so a file may return to an earlier text; on a stream within the watermark on `modified_at`."""
    version = ["path", "sha256", "modified_at"]
    if files.isStreaming:
        return files.withWatermark("modified_at", delay).dropDuplicatesWithinWatermark(version)
    return files.dropDuplicates(version)


def stream_index(
    versions: DataFrame, load: Callable[[], tuple[DataFrame, DataFrame]], store: Callable[[DataFrame, DataFrame, int], None]
) -> DataStreamWriter:
    """Keep `edges` current as file versions arrive, in a store of the caller's. `edge_store.py` brings one that writes changes only.

    `load()` gives the current (edges, files), `store(edges, files, batch_id)`
    writes the next ones to a new place; it must ignore a batch it has already
    stored, since a batch may come twice after a failure.
    """

    def upkeep(batch: DataFrame, batch_id: int) -> None:
        # The newest version per path counts when several arrive together.
        newest = batch.groupBy("path").agg(F.max_by(F.struct("content", "sha256"), "modified_at").alias("v")).select(
            "path", "v.content", "v.sha256")
        edges, files = load()
        known = files.join(newest.select("path"), "path", "left_anti").unionByName(newest.select(*files.columns))
        fresh = edges_of(resolve_imports(extract_imports(newest), known))
        store(incremental_reindex(edges, newest.select("path"), fresh), known, batch_id)

    return new_versions(versions).writeStream.foreachBatch(upkeep)
