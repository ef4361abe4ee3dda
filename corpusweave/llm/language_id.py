"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound by permuting its
letters' vectors by their place and multiplying them; a text bundles (adds) its
trigrams, a language bundles its texts. A text gets the language whose
bundle has the largest cosine with its own. Sums are whole numbers, so the
prototypes do not depend on how the work was split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 512
SYMBOLS = 64  # 0 is the gap between words, 1-26 are a-z, the rest is shared by all other letters
SEED = 7
_KEPT: dict = {}


def _symbols() -> np.ndarray:
    """Symbol of each code point below 0x3000; letters beyond share symbols by their code."""
    table = np.zeros(0x3000, np.uint8)
    for code in range(0x3000):
        if chr(code).isalpha():
            table[code] = code - 96 if 97 <= code <= 122 else 27 + code % (SYMBOLS - 27)
    return table


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text and how often each occurs; none if it has no letter."""
    if "symbols" not in _KEPT:
        _KEPT["symbols"] = _symbols()
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    low = codes < 0x3000
    found = _KEPT["symbols"][np.where(low, codes, 0)]
    if not low.all():
        far = np.flatnonzero(~low)
        found[far] = [27 + int(c) % (SYMBOLS - 27) if chr(c).isalpha() else 0 for c in codes[far]]
    if not found.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.concatenate([[0], found, [0]]).astype(np.int64)
    found = found[(found > 0) | np.concatenate([[True], found[:-1] > 0])]
    gram = (found[:-2] * SYMBOLS + found[1:-1]) * SYMBOLS + found[2:]
    return np.unique(gram, return_counts=True)


class _Space:
    """Bound trigram vectors, made when first needed and kept up to a bounded number."""

    MOST = 40_000

    def __init__(self, dimensions: int, seed: int):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, dimensions))
        self.first, self.second, self.third = np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.vectors = np.zeros((0, dimensions), np.float32)
        self.used = 0

    def bundle(self, grams: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Sum of the vectors of `grams`, taken in slices that fit in the space."""
        return sum(self._part(grams[k : k + self.MOST], times[k : k + self.MOST]) for k in range(0, len(grams), self.MOST))

    def _part(self, grams: np.ndarray, times: np.ndarray) -> np.ndarray:
        new = grams[self.row[grams] < 0]
        if len(new):
            if self.used + len(new) > self.MOST:
                self.row[:] = -1
                self.used, new = 0, grams
            if self.used + len(new) > len(self.vectors):
                grown = np.zeros((min(self.MOST, 2 * (self.used + len(new))), self.vectors.shape[1]), np.float32)
                grown[: self.used] = self.vectors[: self.used]
                self.vectors = grown
            a, b, c = new // SYMBOLS**2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
            self.vectors[self.used : self.used + len(new)] = self.first[a] * self.second[b] * self.third[c]
            self.row[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return times.astype(np.float32) @ self.vectors[self.row[grams]]


def learn_profiles(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototype of each language in `docs` (text, lang), over all rows; rows with a null are left out.

    Each task sends one vector per language, and those are added by Spark; the driver gets one vector per
    language, so the languages should number thousands at most.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = _Space(dimensions, seed), {}
        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                grams, times = _grams(text)
                if len(grams):
                    total[lang] = total.get(lang, 0) + np.rint(space.bundle(grams, times)).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "bundle": pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))})

    known = docs.select("text", "lang").filter("text is not null and lang is not null")
    parts = known.mapInArrow(sums, "lang string, bundle array<long>").select("lang", F.posexplode("bundle").alias("d", "v"))
    out: dict[str, np.ndarray] = {}
    for lang, d, v in parts.groupBy("lang", "d").agg(F.sum("v").alias("v")).collect():
        out.setdefault(lang, np.zeros(dimensions))[d] = v
    return dict(sorted(out.items()))


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (the largest cosine, 0 at least) and margin over the next language, from `text` alone.

    `carry` names columns to hand through.

    Null texts, texts without a letter and all texts where no language was learned are `und` with score 0.
    Ties go to the language first in the alphabet. Rows are judged one by one, so equal rows get equal
    results; other columns are ignored; an empty table gives an empty table.
    """
    names = list(profiles)
    basis = np.array([profiles[n] / max(np.linalg.norm(profiles[n]), 1e-9) for n in names], np.float32)

    def judged(text: str | None, space: _Space) -> tuple[str, float, float]:
        grams, times = _grams(text or "")
        if not len(grams) or not names:
            return "und", 0.0, 0.0
        bundle = space.bundle(grams, times)
        cosines = basis @ (bundle / max(float(np.linalg.norm(bundle)), 1e-9))
        best = int(np.argmax(cosines))
        rest = np.delete(cosines, best)
        return names[best], min(1.0, max(0.0, float(cosines[best]))), float(cosines[best] - rest.max()) if len(rest) else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _Space(dimensions, seed)
        for batch in batches:
            langs, scores, margins = zip(*(judged(t, space) for t in batch["text"].to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(batch[c] for c in carry), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                ["doc_id", *carry, "lang_pred", "score", "margin"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in carry if c != "text"))
    kept = [given.schema[c] for c in ("doc_id", *carry)]
    return given.mapInArrow(run, T.StructType(kept).add("lang_pred", "string").add("score", "double").add("margin", "double"))


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn_profiles(docs.filter(~held_out(F.col("doc_id"))))
    out = predict_language(docs, profiles)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin")


QUERIES = {"op2_language_id": (op2_language_id, None)}
