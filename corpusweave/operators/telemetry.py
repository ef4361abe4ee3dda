"""Request, queue and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import Ordered


def _mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, total.cast("double") / n).otherwise(F.lit(0.0))


def request_metrics(requests: DataFrame) -> DataFrame:
    """Requests, successes, failures and mean latency per plugin, and overall (plugin null)."""
    ms = F.col("ms").cast("decimal(18,6)")
    return requests.rollup("plugin").agg(
        F.count("*").alias("requests"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"),
        _mean(F.sum(ms), F.count("*")).alias("mean_ms"))


def health(requests: DataFrame) -> DataFrame:
    """Success rate in percent (100 without requests) and what it means."""
    df = requests.agg(F.count("*").alias("requests"), F.count_if("ok").alias("ok"))
    rate = F.when(F.col("requests") > 0, F.col("ok") / F.col("requests") * 100.0).otherwise(F.lit(100.0))
    df = df.withColumn("success_rate", rate)
    return df.withColumn("status", F.when(F.col("success_rate") >= 95.0, "success").when(
        F.col("success_rate") >= 75.0, "warning").otherwise("error"))


def latency_percentiles(requests: DataFrame, keys: tuple[str, ...] = (), percents: tuple[int, ...] = (95, 99)) -> DataFrame:
    """Minimum, mean, maximum and exact percentiles per key.

    pXX is the element at 0-based index floor(n * XX / 100) of the sorted
    latencies. Ranks are counted over ranges of the sorted values, so no key's
    values have to fit one task; see `approximate_percentiles` for one pass.
    """
    keys = list(keys)
    ranked = Ordered(requests.select(*keys, "request_id", "ms"), keys, ["ms", "request_id"]).row_number("_rank").result()
    totals = requests.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.min("ms").alias("min_ms"),
        _mean(F.sum(F.col("ms").cast("decimal(18,6)")), F.count("*")).alias("mean_ms"), F.max("ms").alias("max_ms"))
    wanted = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.explode_outer(F.array(*[
        F.struct(F.lit(p).alias("p"), (F.floor(F.col("requests") * p / 100) + 1).cast("bigint").alias("r"))
        for p in percents])).alias("w"))
    on = [ranked["_rank"] == F.col("w.r"), *[ranked[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    hit = ranked.join(wanted, on).groupBy(*keys).agg(*[
        F.max(F.when(F.col("w.p") == p, F.col("ms"))).alias(f"p{p}_ms") for p in percents])
    # Each side has one row per key; a grouping joins them up, with or without keys.
    columns = [c for c in [*totals.columns, *hit.columns] if c not in keys]
    both = totals.unionByName(hit, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in dict.fromkeys(columns)])


def approximate_percentiles(requests: DataFrame, keys: tuple[str, ...] = (), accuracy: int = 10000) -> DataFrame:
    """p95 and p99 in one mergeable pass, with a rank error below n / accuracy."""
    return requests.groupBy(*keys).agg(
        F.percentile_approx("ms", 0.95, accuracy).alias("p95_ms"), F.percentile_approx("ms", 0.99, accuracy).alias("p99_ms"))


def cache_effectiveness(accesses: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Hits, misses and hit ratio in percent, 0 without accesses, from `accesses(hit)`."""
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    ratio = F.when(hits + misses > 0, hits / (hits + misses) * 100.0).otherwise(F.lit(0.0))
    return accesses.groupBy(*keys).agg(hits.alias("hits"), misses.alias("misses"), ratio.alias("hit_ratio"))


OPERATION_TIMEOUT_S = 300.0


def queue_stats(operations: DataFrame, keys: tuple[str, ...] = (), timeout_s: float = OPERATION_TIMEOUT_S) -> DataFrame:
    """Operations in total, pending, completed and failed, waits and whether the queue is idle.

    `wait_s` null means pending; a wait above the timeout means failed. The
    mean is over all started operations, failed ones included.
    """
    wait = F.col("wait_s")
    started, failed = wait.isNotNull(), wait > timeout_s
    total, pending = F.count("*"), F.count_if(~started)
    mean = _mean(F.sum(wait.cast("decimal(18,6)")), F.count_if(started))
    return operations.groupBy(*keys).agg(
        total.alias("operations"), pending.alias("pending"), F.count_if(started & ~failed).alias("completed"),
        F.count_if(failed).alias("failed"), mean.alias("mean_wait_of_started_s"),
        F.coalesce(F.max(wait), F.lit(0.0)).alias("max_wait_s"), (pending == 0).alias("idle"))


def run_report(runs: DataFrame) -> DataFrame:
    """Passed and failed runs, builds by outcome and pass rate per project."""
    passed = F.count_if("passed")
    return runs.groupBy("project").agg(
        F.count("*").alias("runs"), passed.alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.count_if("build_passed").alias("builds_passed"), F.count_if(~F.col("build_passed")).alias("builds_failed"),
        F.count_if(F.col("build_passed").isNull()).alias("builds_skipped"),
        (passed / F.count("*") * 100.0).alias("pass_rate"))


# Default limits in milliseconds by metric and tier.
LIMITS_MS = [
    ("directory_move_detect", "default", 100),
    ("directory_move_doc_rewrite", "default", 1500),
    ("directory_move_convert", "default", 300),
    ("prune_planning", "120", 100),
    ("prune_planning", "500", 300),
    ("prune_planning", "1000", 700),
]


def threshold_exceedances(measures: DataFrame, limits: DataFrame | list[tuple[str, str, int]] | None = None) -> DataFrame:
    """Measures (metric, tier, ms) above their limit, with it as `limit_ms`.

    `limits` is a table (metric, tier, limit_ms), joined by hash, or a short list of literals. Of several limits for
    one metric and tier the lowest holds; measures without a limit, or with a null metric or tier, are not above one.
    """
    if isinstance(limits, DataFrame):
        lowest = limits.groupBy("metric", "tier").agg(F.min("limit_ms").cast("bigint").alias("limit_ms"))
        found = measures.join(lowest, ["metric", "tier"]).filter(F.col("ms") > F.col("limit_ms"))
        return found.select(*measures.columns, "limit_ms")
    lowest = {}
    for metric, tier, ms in limits or LIMITS_MS:
        lowest[f"{metric}/{tier}"] = min(ms, lowest.get(f"{metric}/{tier}", ms))
    pairs = [x for key, ms in lowest.items() for x in (F.lit(key), F.lit(ms).cast("bigint"))]
    limit = F.element_at(F.create_map(*pairs), F.concat("metric", F.lit("/"), "tier"))
    return measures.withColumn("limit_ms", limit).filter(F.col("ms") > F.col("limit_ms"))


def regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Diagnostics that occur more often than in the baseline, with the surplus.

    Takes any columns. Counting both sides replaces a row-wise difference, so a
    diagnostic that fills a third of a side is one row after the first step.
    """
    columns = baseline.columns
    tag = lambda df, side: df.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("n", F.col("n") * side)
    both = tag(current, 1).unionByName(tag(baseline, -1))
    return both.groupBy(*columns).agg(F.sum("n").alias("surplus")).filter(F.col("surplus") > 0)


def gate(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Counts of both sides and whether the check fails: only when the count rises."""
    both = baseline.select(F.lit(1).alias("b"), F.lit(0).alias("c")).unionAll(
        current.select(F.lit(0).alias("b"), F.lit(1).alias("c")))
    df = both.agg(F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("baseline"),
                  F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("current"))
    return df.withColumn("failed", F.col("current") > F.col("baseline"))
