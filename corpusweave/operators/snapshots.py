"""Changes between snapshots and incremental upkeep of derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed, modified or unchanged per path, from (path, sha256) tables."""
    joined = old.select("path", F.col("sha256").alias("old_sha")).join(
        new.select("path", F.col("sha256").alias("new_sha")), "path", "full_outer")
    state = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed").when(
        F.col("old_sha") != F.col("new_sha"), "modified").otherwise("unchanged")
    return joined.select("path", state.alias("state"))


def incremental_reindex(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges after some files changed: theirs are dropped, `fresh` ones are added.

    `changed(path)` lists changed and removed files; `edges` holds each edge once.
    """
    paths = changed.select(F.col("path").alias("src")).distinct()
    kept = edges.join(paths, "src", "left_anti").select("src", "dst")
    added = fresh.join(paths, "src", "left_semi").select("src", "dst").distinct()
    return kept.unionByName(added)


# Lifetimes in seconds.
PARSE_INDEX_TTL_S = 3600
FILE_LIST_TTL_S = 120


def expired(index: DataFrame, now: Column, ttl_s: int = PARSE_INDEX_TTL_S) -> DataFrame:
    """Entries whose `cached_at` is more than the lifetime before `now`."""
    return index.filter(F.col("cached_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_s)))
