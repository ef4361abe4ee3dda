"""Suffix-array dedup: remove bytes that lie in a long string which occurs elsewhere in the corpus.

Suffixes are compared to a fixed depth only, so a suffix is named by the fingerprint of
that many bytes; buckets of names are sorted one at a time, and suffixes with equal names
stand together, as they would in a suffix array of that depth. The difference-cover sample is
sorted first. A suffix whose cover samples within reach all rank alone can tie with no other, so it is left out of
the blocks: only suffixes that hold a sample with a shared rank are sorted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.repeats import RepeatedWindows, Windows
from corpusweave.llm.substring_dedup import span_array, spans_of

#: 307 = 17 * 17 + 17 + 1: 18 of 307 positions are in the sample, each compared over 94 bytes.
COVER = 307
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_bytes binary"


def _cut(ids: list, texts: list[bytes], masks: list[np.ndarray]) -> pa.Table:
    spans = [spans_of(m) for m in masks]
    kept = [np.frombuffer(t, np.uint8)[~m].tobytes() if len(s) else t for t, m, s in zip(texts, masks, spans)]
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()),
        "n_bytes": pa.array(list(map(len, texts)), pa.int64()),
        "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
        "n_spans": pa.array([len(s) for s in spans], pa.int64()),
        "spans": span_array(spans),
        "kept_bytes": pa.array(kept, pa.binary()),
    })


def suffix_dedup(docs: DataFrame, depth: int = 400, cover: int = COVER) -> DataFrame:
    """Each document without the bytes covered by a `depth`-byte string that also starts anywhere else.

    Matches never cross documents. A null text is empty; a text shorter than `depth` stays whole; equal rows are
    copies of each other; an empty table gives an empty table; other columns are
    ignored. Spans are byte ranges, half open. What is left may end within a
    character, so it is given as bytes.
    """
    return RepeatedWindows(docs, Windows("byte", depth, cover)).covered(_cut, SCHEMA)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), "spans")


QUERIES = {"op4_suffix_dedup": (op4_suffix_dedup, None)}
