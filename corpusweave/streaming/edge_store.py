"""A stored reference graph that follows file versions: bucketed deltas, newest version wins, tombstones, compaction.

Layout below the store's folder, all of it Parquet written by Spark:

    delta/batch=<id>/bucket=<n>   one row per file version that a batch brought
    base/upto=<id>/bucket=<n>     the newest row of every file after batch <id>
    compacted                     one row per finished base

A file's row holds all its edges, so a batch writes the rows of changed files only, into the
buckets of their paths, and a batch that comes twice overwrites its own folder with the same rows. Versions are
ordered by (modified_at, batch): a late version never hides a newer one, a file that returns to an earlier text is a new
version, and a removed file stays as a tombstone so that versions from before its removal stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.imports import extract_imports, is_external, resolve_imports
from ..session import pinned

ROW = "src string, modified_at timestamp, sha256 string, deleted boolean, dsts array<string>, missing array<string>"
BUCKETS = 64


class EdgeStore:
    """Edges of a corpus under `path`. One writer at a time (a stream has one); readers see whole batches.

    Null texts are empty; versions equal in path and time are ordered by the batch that brought them, and within a batch
    a removal counts as the later one. Reading merges deltas by one aggregation on the path; `compact` folds them into a base.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        empty = spark.createDataFrame([], ROW)
        for kind, key in (("delta", "batch"), ("base", "upto")):
            empty.write.mode("ignore").parquet(f"{self.path}/{kind}/{key}=-1/bucket=0")
        spark.createDataFrame([(-1,)], "upto bigint").write.mode("ignore").parquet(f"{self.path}/compacted")

    def _bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _rows(self, but: int | None = None) -> DataFrame:
        """Rows of the last base and the deltas behind it, without those of batch `but`."""
        upto = self.spark.read.parquet(f"{self.path}/compacted").agg(F.max("upto")).first()[0]
        read = lambda kind, key: self.spark.read.schema(f"{ROW}, {key} bigint, bucket int").option("basePath", f"{self.path}/{kind}").parquet(
            f"{self.path}/{kind}").withColumnRenamed(key, "batch")
        deltas = read("delta", "batch").filter(F.col("batch") > upto)
        if but is not None:
            deltas = deltas.filter(F.col("batch") != but)
        return read("base", "upto").filter(F.col("batch") == upto).unionByName(deltas)

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c != "src"]
        best = F.max_by(F.struct(*columns), F.struct("modified_at", "batch"))
        return rows.groupBy("src").agg(best.alias("v")).select("src", *[f"v.{c}" for c in columns])

    def files(self) -> DataFrame:
        """path, modified_at and sha256 of files that are there."""
        return self._newest(self._rows().select("src", "modified_at", "sha256", "deleted", "batch")).filter("not deleted").select(
            F.col("src").alias("path"), "modified_at", "sha256")

    def edges(self) -> DataFrame:
        """Distinct (src, dst) between files that are there."""
        now = self._newest(self._rows()).filter("not deleted")
        pairs = now.select("src", F.explode_outer("dsts").alias("dst")).filter("dst is not null")
        return pairs.join(now.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")

    def importers(self, targets: DataFrame) -> DataFrame:
        """Edges into `targets(path)`."""
        return self.edges().join(targets.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")

    def apply(self, versions: DataFrame, batch_id: int) -> None:
        """Take in file versions (path, content, sha256, modified_at, and `deleted` if files can go).

        Besides the files that changed, those with an import that a new file now answers get a new row.
        The list of paths is read for resolving; of the rows, only those in the buckets that the batch touches.
        """
        gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in versions.columns else F.lit(False)
        given = versions.select("path", "content", "sha256", "modified_at", gone.alias("deleted"))
        newest = given.groupBy("path").agg(F.max_by(F.struct("content", "sha256", "modified_at", "deleted"), F.struct("modified_at", "deleted", "sha256")).alias("v")).select(
            "path", "v.*", self._bucket(F.col("path")).alias("bucket"))
        touched = [r.bucket for r in newest.select("bucket").distinct().collect()]  # as many as there are buckets, at most
        before = self._rows(but=batch_id)
        known = self._newest(before.filter(F.col("bucket").isin(touched)).select("src", "modified_at", "deleted", "batch"))
        stored = known.select(F.col("src").alias("path"), F.col("modified_at").alias("_at"), F.col("deleted").alias("_gone"))
        joined = newest.join(stored, "path", "left")
        changed = pinned(joined.filter(F.col("_at").isNull() | (F.col("modified_at") >= F.col("_at"))))
        there = self._newest(before.select("src", "modified_at", "deleted", "batch")).filter("not deleted").select(F.col("src").alias("path"))
        live = changed.filter("not deleted")
        paths = there.join(changed.select("path"), "path", "left_anti").unionByName(live.select("path"))
        fresh = resolve_imports(extract_imports(live.select("path", F.coalesce("content", F.lit("")).alias("content"))), paths)
        inside = ~is_external(F.col("module_path"), F.col("language"))
        per_file = fresh.groupBy("path").agg(
            F.sort_array(F.collect_set("target")).alias("dsts"),
            F.sort_array(F.collect_set(F.when(F.col("target").isNull() & inside, F.col("module_path")))).alias("missing"))
        none = F.array().cast("array<string>")
        rows = changed.join(per_file, "path", "left").select(
            F.col("path").alias("src"), "modified_at", "sha256", "deleted", F.coalesce("dsts", none).alias("dsts"), F.coalesce("missing", none).alias("missing"), "bucket")
        appeared = live.filter(F.col("_at").isNull() | F.col("_gone"))
        if not appeared.isEmpty():
            rows = rows.unionByName(self._answered(before, changed, appeared.select("path")))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta/batch={batch_id}")

    def _answered(self, before: DataFrame, changed: DataFrame, appeared: DataFrame) -> DataFrame:
        """New rows of unchanged files with an import that one of the files in `appeared` answers."""
        now = self._newest(before).filter("not deleted and size(missing) > 0").join(
            changed.select(F.col("path").alias("src")), "src", "left_anti")
        asked = now.select(F.col("src").alias("path"), F.explode_outer("missing").alias("module_path"))
        found = resolve_imports(asked, appeared).filter("target is not null")
        got = found.groupBy(F.col("path").alias("src")).agg(F.collect_set("target").alias("_dsts"), F.collect_set("module_path").alias("_specs"))
        return now.join(got, "src").select(
            "src", "modified_at", "sha256", "deleted", F.array_union("dsts", "_dsts").alias("dsts"), F.array_except("missing", "_specs").alias("missing"), "bucket")

    def compact(self) -> None:
        """Fold all deltas into a new base; readers go over to it once it is complete. Older folders may then be deleted."""
        rows = self._rows()
        upto = rows.agg(F.max("batch")).first()[0]
        if upto is None:
            return
        now = self._newest(rows).drop("batch").withColumn("bucket", self._bucket(F.col("src")))
        now.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/upto={upto}")
        self.spark.createDataFrame([(upto,)], "upto bigint").write.mode("append").parquet(f"{self.path}/compacted")


def stream_edges(versions: DataFrame, store: EdgeStore, compact_every: int = 0) -> DataStreamWriter:
    """Keep `store` current as file versions arrive; every `compact_every` batches (0: never) it is compacted."""

    def upkeep(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            store.compact()

    return versions.writeStream.foreachBatch(upkeep)
