"""Substring dedup: remove words that lie in a passage which occurs elsewhere in the corpus."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.repeats import RepeatedWindows, Windows

#: 13 = 3 * 3 + 3 + 1: four of thirteen word positions are anchors, each of 23 words.
COVER = 13
SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def spans_of(mask: np.ndarray) -> np.ndarray:
    """Start and end of each run of true values."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges.reshape(-1, 2)


def span_array(spans: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
    flat = np.concatenate([*spans, np.zeros((0, 2), np.int64)])
    parts = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), parts)


def _cut(ids: list, texts: list[bytes], masks: list[np.ndarray]) -> pa.Table:
    kept = [b" ".join(compress(t.split(), (~m).tolist()) if m.any() else t.split()).decode() for t, m in zip(texts, masks)]
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()),
        "n_words": pa.array([len(m) for m in masks], pa.int64()),
        "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
        "spans": span_array([spans_of(m) for m in masks]),
        "kept_text": pa.array(kept, pa.string()),
    })


def substring_dedup(docs: DataFrame, window: int = 35, cover: int = COVER) -> DataFrame:
    """Each document without the words covered by `window` consecutive words that also start anywhere else.

    Words are runs of anything but ASCII white space, compared unchanged. A null
    or blank text has no words and gives an empty text; a text shorter than the
    window stays whole; equal rows are copies of each other and lose every window; an empty table
    gives an empty table. Only `doc_id` and `text` are read, whatever other columns there are.
    Windows are judged on the input. Spans are word ranges, half open.

    Anchors are windows of `window - cover + 1` words at the places of a difference cover
    modulo `cover`: two equal windows share one at the same distance from their starts.
    """
    return RepeatedWindows(docs, Windows("word", window, cover)).covered(_cut, SCHEMA)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "spans")


QUERIES = {"op1_substring_dedup": (op1_substring_dedup, None)}
