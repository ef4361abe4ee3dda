"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from corpusweave.session import checkpoint_dir, released


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table under `spark.checkpoint.dir`, read back: it outlives executors and has no lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with released(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing will read again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """`df` with a broadcast hint if it is counted to have at most `most_rows` rows; else joins shuffle."""
    with released(df.sparkSession):
        return df.hint("broadcast") if df.limit(most_rows + 1).count() <= most_rows else df
