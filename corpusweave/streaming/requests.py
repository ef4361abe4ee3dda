"""Pairing of requests and responses; metrics per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import micros

REQUEST_TIMEOUT = "60 seconds"


def pair_requests(requests: DataFrame, responses: DataFrame, timeout: str = REQUEST_TIMEOUT, delay: str = "0 seconds") -> DataFrame:
    """Requests (request_id, req_ts) with their response (request_id, resp_ts) or a timeout.

    The same interval join in batch and stream; on a stream both sides carry
    watermarks, which bound the state to one timeout's worth of requests.
    """
    right = responses.select(F.col("request_id").alias("_id"), "resp_ts")
    left = requests
    if requests.isStreaming:
        left = left.withWatermark("req_ts", delay)
    if responses.isStreaming:
        right = right.withWatermark("resp_ts", delay)
    inside = (
        (F.col("request_id") == F.col("_id")) & (F.col("resp_ts") >= F.col("req_ts"))
        & (F.col("resp_ts") <= F.col("req_ts") + F.expr(f"interval {timeout}")))
    joined = left.join(right, inside, "left_outer")
    status = F.when(F.col("_id").isNull(), "timeout").otherwise("answered")
    return joined.select("request_id", "req_ts", "resp_ts", status.alias("status"),
                         ((micros(F.col("resp_ts")) - micros(F.col("req_ts"))) / 1000.0).alias("ms"))


def windowed_metrics(requests: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Requests, failures and mean latency per plugin and tumbling or sliding window.

    On a stream a window is final when the watermark passes its end; rows that
    come later are dropped and show up in the query's progress.
    """
    df = requests.withWatermark("ts", delay) if requests.isStreaming else requests
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return df.groupBy(window.alias("w"), "plugin").agg(
        F.count("*").alias("requests"), F.count_if("ok").alias("ok"),
        (F.sum(F.col("ms").cast("decimal(18,6)")).cast("double") / F.count("*")).alias("mean_ms"),
        F.max("ms").alias("max_ms")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "plugin", "requests", "ok", "mean_ms", "max_ms")
