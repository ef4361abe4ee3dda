"""Which windows of a corpus occur more than once: texts and fingerprint buckets ask and answer.

Texts are dealt over groups by a hash of the row; fingerprints over buckets by
their value. A group asks every bucket about the distinct fingerprints it holds;
a bucket answers one bit for each: does it occur in another place. So

* nothing but 7 bytes a fingerprint travels, and one bit comes back;
* a fingerprint that a third of all documents share is asked once per group,
  whatever its number of places, so no bucket grows with a hot passage;
* no pair of documents is ever built.

Two questions are asked. First about anchors: short windows that start at the
places of a difference cover. Two equal long windows always hold an equal anchor
at the same distance from their starts. Then about the long windows themselves,
but only those that hold an anchor known to repeat; with them go the answers about anchors, for
the group to read again at the end. Texts that are copies of each other
take part once: one copy asks, marked as occurring more than once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import hashing

GROUPS_PER_PARTITION = 2
BUCKETS_PER_PARTITION = 1
SENT_BYTES = 7

ASK = "bucket int, group int, prints binary, known binary, carried binary"
_NO_ROLE, _FIRST_COPY, _OTHER_COPY = 0, 1, 2


@dataclass(frozen=True)
class Windows:
    """What to look for: `size` consecutive units (words or bytes), and the cover's modulus."""

    unit: str
    size: int
    modulus: int

    @property
    def anchor(self) -> int:
        return self.size - self.modulus + 1


class _Laid:
    """Units of some texts laid end to end."""

    def __init__(self, spec: Windows, texts: list[bytes]):
        if spec.unit == "word":
            words = hashing.Words(texts, hashing.SPACED)
            values, self.counts = words.hash, words.counts
        else:
            values = hashing.byte_values()[np.frombuffer(b"".join(texts), np.uint8)]
            self.counts = np.fromiter(map(len, texts), np.int64, len(texts))
        self.sums = hashing.prefix_sums(values)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.spec = spec

    def _places(self) -> np.ndarray:
        return np.arange(self.first[-1]) - np.repeat(self.first[:-1], self.counts)

    def _left(self) -> np.ndarray:
        return np.repeat(self.first[1:], self.counts) - np.arange(self.first[-1])

    def anchors(self, use: np.ndarray) -> np.ndarray:
        """Where anchors start, in texts to use."""
        at_cover = np.zeros(self.spec.modulus, bool)
        at_cover[hashing.difference_cover(self.spec.modulus)] = True
        keep = at_cover[self._places() % self.spec.modulus] & (self._left() >= self.spec.anchor)
        return np.flatnonzero(keep & np.repeat(use, self.counts))

    def candidates(self, anchors: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Starts of long windows that hold one of the repeated `anchors`, or lie in a text marked `whole`."""
        n = self.first[-1]
        seen = np.zeros(n + 1, np.int32)
        seen[anchors + 1] = 1
        seen = np.cumsum(seen, dtype=np.int32)
        starts = np.arange(n)
        held = seen[np.minimum(starts + self.spec.modulus, n)] > seen[starts]
        return np.flatnonzero((held | np.repeat(whole, self.counts)) & (self._left() >= self.spec.size))

    def prints(self, starts: np.ndarray, size: int) -> np.ndarray:
        return hashing.range_hashes(self.sums, starts, starts + size)

    def text_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, starts, side="right") - 1

    def covered(self, starts: np.ndarray) -> np.ndarray:
        change = np.zeros(self.first[-1] + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.spec.size, -1)
        return np.cumsum(change[:-1]) > 0


class Question:
    """Distinct fingerprints of a group, in ascending order, and whether they are known to repeat."""

    def __init__(self, prints: list[np.ndarray], known: list[np.ndarray] | None = None):
        every = np.concatenate([*prints, np.zeros(0, np.uint64)])
        sure = np.zeros(len(every), bool) if known is None else np.concatenate([*known, np.zeros(0, bool)])
        self.values, where, times = np.unique(every, return_inverse=True, return_counts=True)
        self.known = (times > 1) | (np.bincount(where, weights=sure, minlength=len(times)) > 0)
        self.where = where

    def slices(self, buckets: int) -> Iterator[tuple[int, slice]]:
        which = ((self.values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        edges = np.flatnonzero(np.diff(which, prepend=np.uint64(buckets + 1)))
        for begin, end in zip(edges, [*edges[1:], len(which)]):
            yield int(which[begin]), slice(begin, end)

    def ask(self, group: int, buckets: int, carried: dict[int, bytes] | None = None) -> pa.Table:
        """One row a bucket; `carried` holds what a bucket is to send back besides its answer."""
        parts, carried = dict(self.slices(buckets)), carried or {}
        rows = []
        for bucket in sorted(parts.keys() | carried.keys()):
            part = parts.get(bucket, slice(0, 0))
            wide = np.ascontiguousarray(self.values[part]).astype("<u8").view(np.uint8).reshape(-1, 8)
            rows.append((bucket, group, wide[:, :SENT_BYTES].tobytes(), np.packbits(self.known[part]).tobytes(), carried.get(bucket)))
        columns = list(zip(*rows)) or [[], [], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                        names=["bucket", "group", "prints", "known", "carried"])

    def hear(self, answers: dict[int, bytes], buckets: int) -> np.ndarray:
        """One flag for each fingerprint that was put in, repeats included."""
        flags = np.zeros(len(self.values), bool)
        for bucket, part in self.slices(buckets):
            n = part.stop - part.start
            flags[part] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=n).astype(bool)
        return flags[self.where]


def _answer(table: pa.Table) -> pa.Table:
    """One bucket: which of the fingerprints asked about occur in more than one place."""
    sent = table["prints"].to_pylist()
    sizes = np.array([len(x) // SENT_BYTES for x in sent])
    wide = np.zeros((sizes.sum(), 8), np.uint8)
    wide[:, :SENT_BYTES] = np.frombuffer(b"".join(sent), np.uint8).reshape(-1, SENT_BYTES)
    known = np.concatenate([np.unpackbits(np.frombuffer(k, np.uint8), count=n) for k, n in zip(table["known"].to_pylist(), sizes)])
    _, where, times = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    again = ((times > 1) | (np.bincount(where, weights=known) > 0))[where]
    flags = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(sizes)[:-1])]
    return pa.table({"group": table["group"], "bucket": table["bucket"], "flags": pa.array(flags, pa.binary()), "carried": table["carried"]})


def answered(asked: DataFrame) -> DataFrame:
    """group, bucket, flags, carried for what the groups `asked`."""
    return asked.groupBy("bucket").applyInArrow(_answer, "group int, bucket int, flags binary, carried binary")


class RepeatedWindows:
    """Finds, for every text of `docs`, the units covered by windows that occur elsewhere.

    `docs` has any id column and `text`; null texts are empty, and repeated rows count as copies.
    """

    def __init__(self, docs: DataFrame, spec: Windows):
        spark = docs.sparkSession
        self.spec = spec
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.groups = self.parts * GROUPS_PER_PARTITION
        self.buckets = max(1, int(self.parts * BUCKETS_PER_PARTITION))
        keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
        keyed = keyed.withColumn("group", F.pmod("row_key", F.lit(self.groups)).cast("int"))
        #: All uses share one shuffle of the texts.
        self.texts = keyed.repartition(self.parts, "group")
        self.roles = self._roles(keyed)

    def _roles(self, keyed: DataFrame) -> DataFrame:
        """Rows whose text occurs more than once; the copy with the smallest key speaks for all."""
        marked = keyed.select("group", "row_key", F.md5("text").alias("mark"))
        copies = marked.groupBy("mark").agg(F.count("*").alias("n"), F.min("row_key").alias("chosen")).filter("n > 1")
        role = F.when(F.col("row_key") == F.col("chosen"), _FIRST_COPY).otherwise(_OTHER_COPY)
        return marked.join(copies, "mark").select(
            F.col("group").alias("to_group"), F.lit("role").alias("kind"), F.col("row_key").alias("about"), role.alias("bucket"),
            F.lit(None).cast("binary").alias("flags"), F.lit(None).cast("binary").alias("carried"))

    def _answers(self, asked: DataFrame, kind: str) -> DataFrame:
        return answered(asked).select(
            F.col("group").alias("to_group"), F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("about"), "bucket", "flags", "carried")

    def _stage(self, told: DataFrame, step: Callable, schema: str) -> DataFrame:
        spec, buckets = self.spec, self.buckets

        def run(key, texts: pa.Table, said: pa.Table) -> pa.Table:
            return step(_Group(spec, buckets, key[0].as_py(), texts, said))

        return self.texts.groupBy("group").cogroup(told.groupBy("to_group")).applyInArrow(run, schema)

    def covered(self, step: Callable[[list, list[bytes], list[np.ndarray]], pa.Table], schema: str) -> DataFrame:
        """`step(doc_ids, texts, masks)` for each group; a mask is true where a unit is covered."""
        anchors = self._answers(self._stage(self.roles, lambda g: g.ask_anchors(), ASK), "anchor")
        windows = self._answers(self._stage(self.roles.unionByName(anchors), lambda g: g.ask_windows(), ASK), "window")
        return self._stage(self.roles.unionByName(windows), lambda g: step(g.ids, g.texts, g.masks()), schema)


class _Group:
    """The texts of one group and what has been said about them."""

    def __init__(self, spec: Windows, buckets: int, number: int, texts: pa.Table, said: pa.Table):
        self.spec, self.buckets, self.number = spec, buckets, number
        self.ids, self.texts = texts["doc_id"].to_pylist(), hashing.encoded(texts["text"])
        roles, self.answers = {}, {"anchor": {}, "window": {}}
        for kind, key, bucket, flags, carried in zip(*(said[c].to_pylist() for c in ("kind", "about", "bucket", "flags", "carried"))):
            if kind == "role":
                roles[key] = bucket
                continue
            self.answers[kind][bucket] = flags
            if carried is not None:
                self.answers["anchor"][bucket] = carried
        self.role = np.array([roles.get(k, _NO_ROLE) for k in texts["row_key"].to_pylist()], np.int8)
        self.laid = []
        for begin, end in hashing.chunks(map(len, self.texts)):
            self.laid.append((_Laid(spec, self.texts[begin:end]), self.role[begin:end]))

    def _asked_anchors(self):
        starts = [x.anchors(role != _OTHER_COPY) for x, role in self.laid]
        prints = [x.prints(s, self.spec.anchor) for (x, _), s in zip(self.laid, starts)]
        return starts, Question(prints, [role[x.text_of(s)] == _FIRST_COPY for (x, role), s in zip(self.laid, starts)])

    def _asked_windows(self):
        starts, question = self._asked_anchors()
        flags = np.split(question.hear(self.answers["anchor"], self.buckets), np.cumsum([len(s) for s in starts])[:-1]) if starts else []
        found = [x.candidates(s[f], role == _FIRST_COPY) for (x, role), s, f in zip(self.laid, starts, flags)]
        prints = [x.prints(s, self.spec.size) for (x, _), s in zip(self.laid, found)]
        return found, Question(prints, [role[x.text_of(s)] == _FIRST_COPY for (x, role), s in zip(self.laid, found)])

    def ask_anchors(self) -> pa.Table:
        return self._asked_anchors()[1].ask(self.number, self.buckets)

    def ask_windows(self) -> pa.Table:
        return self._asked_windows()[1].ask(self.number, self.buckets, self.answers["anchor"])

    def masks(self) -> list[np.ndarray]:
        starts, question = self._asked_windows()
        flags = question.hear(self.answers["window"], self.buckets)
        out, at = [], 0
        for (x, role), s in zip(self.laid, starts):
            mask = x.covered(s[flags[at : at + len(s)]])
            at += len(s)
            mask |= np.repeat((role != _NO_ROLE) & (x.counts >= self.spec.size), x.counts)
            out += np.split(mask, x.first[1:-1])
        return out
