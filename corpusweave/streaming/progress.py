"""State of long-running tasks from begin, report and end events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import Ordered
from ..functions.text import micros


def progress_state(progress: DataFrame) -> DataFrame:
    """State per token after all events so far; the same code for batch and stream.

    A report keeps the title of its begin (`Unknown` without one) and is ignored
    after completion; an end completes; a later begin starts over. The state
    follows from three latest events per token, so it is an ordinary mergeable
    aggregation: partial per task, one small state row per token in a stream,
    and no fold over a token's events. Where events have a `percentage`, the state shows the last one of a task in progress.
    The state of a stream keeps every token; `tracked_tasks` lets completed ones go.
    """
    share = ["percentage"] if "percentage" in progress.columns else []
    order = F.struct("ts", "event_id")
    event = F.struct("kind", "title", "message", "ts", "event_id", *share)
    edge = F.col("kind").isin("begin", "end")
    # Explicit casts keep the state schema the same in every mode.
    grouped = progress.groupBy("token").agg(
        F.max_by(F.when(edge, event), F.when(edge, order)).alias("edge"),
        F.max_by(event, order).alias("last"),
        F.count("*").alias("events"))
    done = F.col("edge.kind") == "end"
    known = F.col("edge").isNotNull()
    return grouped.select(
        "token",
        F.when(known & done, "completed").otherwise("in_progress").alias("state"),
        F.when(known & done, F.lit(None)).when(known, F.col("edge.title")).otherwise("Unknown").alias("title"),
        F.when(known & done, F.col("edge.message")).otherwise(F.col("last.message")).alias("message"),
        *[F.when(~(known & done), F.col(f"last.{c}")).alias(c) for c in share],
        "events")


def _stalled_in_stream(progress: DataFrame, timeout: str, delay: str) -> DataFrame:
    """A begin is given up once the watermark passes its deadline; a later end meets nothing."""
    begins = progress.filter(F.col("kind") == "begin").select(
        "token", F.col("event_id").alias("begin_id"), F.col("ts").alias("begin_ts"), "title")
    ends = progress.filter(F.col("kind") == "end").select(
        F.col("token").alias("end_token"), F.col("ts").alias("end_ts"))
    in_time = (
        (F.col("token") == F.col("end_token")) & (F.col("end_ts") >= F.col("begin_ts"))
        & (F.col("end_ts") <= F.col("begin_ts") + F.expr(f"interval {timeout}")))
    joined = begins.withWatermark("begin_ts", delay).join(ends.withWatermark("end_ts", delay), in_time, "left_outer")
    return joined.filter(F.col("end_token").isNull()).select("token", "begin_id", "begin_ts", "title")


def _stalled_in_batch(progress: DataFrame, timeout: str) -> DataFrame:
    """The next end of each begin by one ordered pass; a busy token never pairs all with all."""
    end = F.col("kind") == "end"
    edges = progress.filter(F.col("kind").isin("begin", "end")).select("token", "kind", "event_id", "ts", "title")
    # Newest first, ends before begins of the same moment: the nearest end is the smallest seen.
    order = [F.col("ts").desc(), end.desc(), F.col("event_id")]
    rows = Ordered(edges, ["token"], order).max_before("_next", F.when(end, -micros(F.col("ts")))).result()
    deadline = micros(F.col("ts") + F.expr(f"interval {timeout}"))
    late = F.col("_next").isNull() | (-F.col("_next") > deadline)
    return rows.filter((F.col("kind") == "begin") & late).select(
        "token", F.col("event_id").alias("begin_id"), F.col("ts").alias("begin_ts"), "title")


def stalled_tasks(progress: DataFrame, timeout: str = "30 seconds", delay: str = "0 seconds") -> DataFrame:
    """Begins without an end in time, as failed with reason timeout."""
    open_tasks = (_stalled_in_stream(progress, timeout, delay) if progress.isStreaming
                  else _stalled_in_batch(progress, timeout))
    return open_tasks.select("*", F.lit("failed").alias("state"), F.lit("timeout").alias("reason"))


def task_alerts(progress: DataFrame, warn: str = "30 seconds", timeout: str = "5 minutes") -> DataFrame:
    """Begins that wait too long: a `warning` once `warn` has passed without an end, `failed` once `timeout` has.

    The batch twin of `tracked_tasks`; one ordered pass finds the next end of each begin, so a
    begin may give two rows. `at` is the moment at which the limit was reached.
    """
    levels = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"), (F.col("ts") + F.expr(f"interval {after}")).alias("at"))
                       for level, reason, after in (("warning", "slow", warn), ("failed", "timeout", timeout))])
    end = F.col("kind") == "end"
    edges = progress.filter(F.col("kind").isin("begin", "end")).select("token", "kind", "event_id", "ts", "title")
    rows = Ordered(edges, ["token"], [F.col("ts").desc(), end.desc(), F.col("event_id")]).max_before(
        "_next", F.when(end, -micros(F.col("ts")))).result()
    each = rows.filter(F.col("kind") == "begin").select(
        "token", F.col("event_id").alias("begin_id"), F.col("ts").alias("begin_ts"), "title", "_next", F.explode_outer(levels).alias("l"))
    late = F.col("_next").isNull() | (-F.col("_next") > micros(F.col("l.at")))
    return each.filter(late).select("token", "begin_id", "begin_ts", "title", "l.level", "l.reason", "l.at")
