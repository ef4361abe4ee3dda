"""Orders: queue rank, running means, eviction, pages, slowest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import Ordered


def queue_order(operations: DataFrame) -> DataFrame:
    """Dispatch rank over the whole queue: smaller priority number first, then first come."""
    ranked = Ordered(operations, [], ["priority", "created_at", "op_id"])
    return ranked.row_number("dispatch_rank").result()


def running_latency(requests: DataFrame) -> DataFrame:
    """Mean latency so far, over all requests and per plugin, after each request.

    Sums are decimals, so the result does not depend on how rows were split.
    """
    ms = F.col("ms").cast("decimal(18,6)")
    one = F.lit(1).cast("bigint")
    overall = Ordered(requests.select("request_id", "plugin", "ts", "ms"), [], ["ts", "request_id"])
    overall.running_sum({"_n": one, "_sum": ms})
    mean = lambda s, n: (F.col(s).cast("double") / F.col(n)).alias
    df = overall.result().select("request_id", "plugin", "ts", "ms", mean("_sum", "_n")("mean_ms"))
    per_plugin = Ordered(df, ["plugin"], ["ts", "request_id"]).running_sum({"_n": one, "_sum": ms})
    return per_plugin.result().select(
        "request_id", "plugin", "ts", "ms", "mean_ms", mean("_sum", "_n")("plugin_mean_ms"))


def evict_oldest(index: DataFrame, max_entries: int) -> DataFrame:
    """Entries to drop from a full index: the oldest tenth of its capacity, at least one."""
    full = index.agg((F.count("*") >= max_entries).alias("full")).scalar()
    return slice_of(index.filter(full), ["cached_at", "path"], 0, max(1, max_entries // 10))


def slice_of(df: DataFrame, order: list[str | Column], offset: int, limit: int) -> DataFrame:
    """Rows `offset` .. `offset + limit` of a total order: a bounded top-k.

    Every task keeps `offset + limit` rows at most, and those meet in one task: the caller's numbers bound it, not the table.
    """
    return df.orderBy(*order).offset(offset).limit(limit)


def page(df: DataFrame, order: list[str | Column], offset: int, limit: int) -> DataFrame:
    """Rows `offset` .. `offset + limit` of an order, with the total number of rows."""
    total = df.agg(F.count("*")).scalar()
    return slice_of(df, order, offset, limit).select(
        "*", total.alias("total"), F.lit(offset).cast("bigint").alias("offset"),
        F.lit(limit).cast("bigint").alias("limit"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key; Spark prunes to k per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k).withColumn(
        name, F.col(name).cast("bigint"))


def slowest(runs: DataFrame, k: int = 5) -> DataFrame:
    """The k slowest runs per project by total time and by operation time."""
    parts = []
    for measure in ("total_ms", "operation_ms"):
        order = [F.col(measure).desc(), F.col("run_id")]
        top = top_per_key(runs, ["project"], order, k)
        parts.append(top.select("project", F.lit(measure).alias("measure"), "rank", "run_id",
                                "test_name", F.col(measure).alias("ms")))
    return parts[0].unionByName(parts[1])
