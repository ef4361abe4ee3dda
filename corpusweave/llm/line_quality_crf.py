"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line with a word is good or bad. What speaks for either are facts of the line
itself and of the lines before and behind it (features), and which labels follow each other
(transitions). Forward and backward sums give each line's chance of being good; a text's quality is the
mean of these, weighted by length, brought to the scale of the labels by a line fitted on the training texts.

Lines carry no labels of their own, so in training each line has the label of its text.
Weights are found by L-BFGS: in each round Spark adds up loss and gradient over all tasks, and the driver
holds one weight vector, whose length does not depend on the data.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import hashing
from corpusweave.llm.storage import written

#: Labelled texts to learn from: at most about so many, chosen by a hash of id and text.
SAMPLE = 20_000
ROUNDS = 30
RIDGE = 1e-4  # of the squared weights, for each line
HELD_OUT = 1  # remainder modulo 3

_UPPER, _LOWER, _DIGIT = (hashing.byte_class(r) for r in ((65, 90), (97, 122), (48, 57)))
_WIDE = hashing.byte_class((0x80, 0xFF))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>{}[]=_~^\\/@+", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_SHOUT = np.isin(np.arange(256), np.frombuffer(b"!", np.uint8))
_BAR = np.isin(np.arange(256), np.frombuffer(b"|<>", np.uint8))
#: Steps of each fact: a feature says that the fact is above the step.
_SHARE = (0.02, 0.05, 0.1, 0.2, 0.35, 0.6, 0.9)
STEPS = {
    "words": (2, 4, 8, 16, 32, 64, 128), "word_length": (2.5, 3.5, 4.5, 5.5, 7.0, 10.0, 20.0), "upper": _SHARE, "digits": _SHARE, "symbols": _SHARE, "shouts": _SHARE,
    "bars": _SHARE, "wide": _SHARE, "repeated": _SHARE, "same_as_last": _SHARE, "stops": (0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15),
    "ends_with_stop": (0.5,), "starts_upper": (0.5,), "seen_before": (0.5,),
}
OWN = sum(map(len, STEPS.values()))
#: A constant, the line's own features and those of the lines before and behind (with one that says there is none).
FEATURES = 1 + OWN + 2 * (OWN + 1)
#: Behind the features: good after good, bad after bad, as bonuses over a change.
WEIGHTS = FEATURES + 2


class Lines:
    """Lines with a word of some texts: how many each text has, their lengths in bytes, and their facts."""

    def __init__(self, texts: list[bytes]):
        words = hashing.Words(texts, hashing.SPACED)
        data = np.frombuffer(words.raw, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        # Texts are laid with a space between them: a line ends at a newline or where its text ends.
        breaks = np.union1d(np.flatnonzero(data == 10), ends - 1)
        line = np.searchsorted(breaks, words.start)
        first = np.flatnonzero(np.diff(line, prepend=-1))
        n_words = np.diff(np.append(first, len(line)))
        number = np.repeat(np.arange(len(first)), n_words)
        begin = words.start[first]
        end = words.end[np.append(first[1:], len(line)) - 1] if len(first) else begin
        self.length = (end - begin).astype(np.float64)
        owner = words.text_of[first]
        self.counts = np.bincount(owner, minlength=len(texts))

        def share(kind: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
            return (sums[end] - sums[begin]) / np.maximum(self.length, 1)

        letters = share(_UPPER) + share(_LOWER) + share(_WIDE)
        same = np.zeros(len(line), bool)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (line[1:] == line[:-1])
        order = np.lexsort((words.hash, number))
        again = np.zeros(len(line), bool)
        again[order[1:]] = (words.hash[order][1:] == words.hash[order][:-1]) & (number[order][1:] == number[order][:-1])
        whole = hashing.range_hashes(hashing.prefix_sums(words.hash), first, first + n_words)
        key = np.lexsort((whole, owner))
        seen = np.zeros(len(first), bool)
        seen[key[1:]] = (whole[key][1:] == whole[key][:-1]) & (owner[key][1:] == owner[key][:-1])
        per_line = lambda flag: np.bincount(number, weights=flag, minlength=len(first)) / np.maximum(n_words, 1)
        self.facts = {
            "words": n_words, "word_length": np.bincount(number, weights=words.end - words.start, minlength=len(first)) / np.maximum(n_words, 1),
            "upper": share(_UPPER) / np.maximum(letters, 1e-9), "digits": share(_DIGIT), "symbols": share(_SYMBOL), "shouts": share(_SHOUT), "bars": share(_BAR),
            "wide": share(_WIDE), "repeated": per_line(again), "same_as_last": per_line(same), "stops": share(_STOP),
            "ends_with_stop": _STOP[data[end - 1]], "starts_upper": _UPPER[data[begin]], "seen_before": seen,
        }
        self.opens = np.zeros(len(first), bool)
        self.opens[np.cumsum(self.counts)[self.counts > 0] - self.counts[self.counts > 0]] = True

    def features(self) -> np.ndarray:
        """A row of zeros and ones for each line."""
        n = len(self.length)
        own = np.empty((n, OWN), bool)
        at = 0
        for name, steps in STEPS.items():
            own[:, at : at + len(steps)] = np.asarray(self.facts[name])[:, None] > np.array(steps)
            at += len(steps)
        out = np.zeros((n, FEATURES), bool)
        out[:, 0] = True
        out[:, 1 : 1 + OWN] = own
        closes = np.append(self.opens[1:], True) if n else self.opens
        for base, alone, move in ((1 + OWN, self.opens, 1), (2 + 2 * OWN, closes, -1)):
            near = np.roll(own, move, 0)
            near[alone] = False
            out[:, base : base + OWN], out[:, base + OWN] = near, alone
        return out


class Chains:
    """Texts' lines as chains, longest text first, so that step t takes the first few of them."""

    def __init__(self, counts: np.ndarray):
        self.first = np.cumsum(counts) - counts
        self.order = np.argsort(-counts, kind="stable")
        self.order = self.order[counts[self.order] > 0]
        self.counts = counts[self.order]
        # Chains with more than t lines.
        self.active = len(self.counts) - np.searchsorted(self.counts[::-1], np.arange(self.counts[0] if len(self.counts) else 0), side="right")

    def at(self, t: int) -> np.ndarray:
        """Line t of each chain that has it."""
        return self.first[self.order[: self.active[t]]] + t

    def sums(self, emission: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log of the total of each chain, each line's chance of good, and how many neighbours are expected to be both bad and both good.

        `emission` is what speaks for good in each line; `stay` what speaks for two bad and for two good lines in a row.
        """
        n = len(emission)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        score = np.stack([np.zeros(n), emission], 1)
        log = np.logaddexp
        for t in range(len(self.active)):
            here = self.at(t)
            if t == 0:
                forward[here] = score[here]
                continue
            before = forward[here - 1]
            forward[here] = score[here] + np.stack([log(before[:, 0] + stay[0], before[:, 1]), log(before[:, 0], before[:, 1] + stay[1])], 1)
        for t in range(len(self.active) - 1, 0, -1):
            here = self.at(t)
            behind = backward[here] + score[here]
            backward[here - 1] = np.stack([log(behind[:, 0] + stay[0], behind[:, 1]), log(behind[:, 0], behind[:, 1] + stay[1])], 1)
        last = self.first[self.order] + self.counts - 1
        total = log(forward[last, 0], forward[last, 1])
        whole = np.zeros(n)
        for t in range(len(self.active)):
            whole[self.at(t)] = total[: self.active[t]]
        good = np.exp(np.minimum(0, forward[:, 1] + backward[:, 1] - whole))
        linked = np.ones(n, bool)
        linked[self.first[self.order]] = False
        linked = np.flatnonzero(linked)
        both = [np.exp(np.minimum(0, forward[linked - 1, k] + stay[k] + score[linked, k] + backward[linked, k] - whole[linked])).sum() for k in (0, 1)]
        return total, good, np.array(both)


def loss_and_gradient(counts: np.ndarray, features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log chance that all lines of each text have the text's label, and its gradient."""
    chains = Chains(counts)
    emission, stay = features @ weights[:FEATURES], weights[FEATURES:]
    total, good, both = chains.sums(emission, stay)
    wanted = np.repeat(labels, counts).astype(float)
    links = np.maximum(counts - 1, 0)
    met = np.array([links[labels == 0].sum(), links[labels == 1].sum()], float)
    loss = total.sum() - (emission * wanted).sum() - (met * stay).sum()
    return float(loss), np.concatenate([features.T @ (good - wanted), both - met])


def lowest(function: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Where a smooth function is low, by L-BFGS with halved steps."""
    x, (value, slope) = start, function(start)
    past: deque = deque(maxlen=memory)
    for _ in range(rounds):
        way, kept = -slope, []
        for s, y in reversed(past):
            a = s @ way / (s @ y)
            kept.append(a)
            way = way - a * y
        way = way * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(slope)))
        for (s, y), a in zip(past, reversed(kept)):
            way = way + (a - y @ way / (s @ y)) * s
        step = 1.0
        for _ in range(12):
            there, slope_there = function(x + step * way)
            if there <= value + 1e-4 * step * (slope @ way):
                break
            step /= 2
        else:
            return x
        if (slope_there - slope) @ way > 0:
            past.append((step * way, slope_there - slope))
        done = value - there < 1e-5 * abs(value)
        x, value, slope = x + step * way, there, slope_there
        if done:
            break
    return x


@dataclass(frozen=True)
class Model:
    """Weights of the field, the share of good training texts, and the line (slope, height) from a text's quality to its score."""

    weights: np.ndarray
    prior: float
    line: tuple[float, float]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, labels = hashing.encoded(batch["text"]), batch["label"].to_numpy(zero_copy_only=False)
        for begin, end in hashing.chunks(map(len, texts)):
            lines = Lines(texts[begin:end])
            bits = np.packbits(lines.features(), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()], pa.binary()) for x in (lines.counts.astype(np.int64), lines.length, bits, labels[begin:end].astype(np.int64))],
                ["counts", "lengths", "bits", "labels"])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    counts, lengths, labels = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["lengths"]), np.frombuffer(row["labels"], np.int64)
    bits = np.frombuffer(row["bits"], np.uint8).reshape(len(lengths), -1)
    return counts, lengths, np.unpackbits(bits, axis=1, count=FEATURES).astype(np.float32), labels


def _summed(packed: DataFrame, function: Callable, size: int) -> np.ndarray:
    """Sum over all rows of the `size` numbers that `function` makes of each; every task sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for row in batch.to_pylist():
                total += function(*_unpacked(row))
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    rows = packed.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r.k] = r.v
    return out


def quality(counts: np.ndarray, lengths: np.ndarray, features: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of good of each line, and the mean by length for each text (0 for texts without lines)."""
    _, good, _ = Chains(counts).sums(features @ weights[:FEATURES], weights[FEATURES:])
    owner = np.repeat(np.arange(len(counts)), counts)
    weight = np.bincount(owner, weights=lengths, minlength=len(counts))
    return good, np.bincount(owner, weights=good * lengths, minlength=len(counts)) / np.maximum(weight, 1)


def learn_quality(labelled: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model of `labelled` (doc_id, text, label of 0 or 1); rows with a null label or text are left out.

    Of more than `sample` rows, those whose hash of id and text is low enough to leave about `sample` are learned from.
    Without rows, every text scores one half.
    """
    rows = labelled.select("doc_id", "text", F.col("label").cast("int").alias("label")).filter("text is not null and label in (0, 1)")
    n, good = rows.agg(F.count("*"), F.avg("label")).first()
    if not n:
        return Model(np.zeros(WEIGHTS), 0.5, (1.0, 0.0))
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    packed = written(rows.mapInArrow(_packed, "counts binary, lengths binary, bits binary, labels binary"), "quality-lines")
    lines = _summed(packed, lambda counts, *_: np.array([counts.sum()], float), 1)[0]

    def field(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def part(counts, lengths, features, labels):
            loss, slope = loss_and_gradient(counts, features, labels, weights)
            return np.concatenate([[loss], slope])

        total = _summed(packed, part, WEIGHTS + 1) / max(lines, 1)
        return total[0] + RIDGE * weights @ weights, total[1:] + 2 * RIDGE * weights

    weights = lowest(field, np.zeros(WEIGHTS), rounds)

    def scale(line: np.ndarray) -> tuple[float, np.ndarray]:
        def part(counts, lengths, features, labels):
            some = counts > 0
            x = _logit(quality(counts, lengths, features, weights)[1])[some]
            z = line[0] * x + line[1]
            miss = 1 / (1 + np.exp(-z)) - labels[some]
            return np.array([(np.logaddexp(0, z) - z * labels[some]).sum(), miss @ x, miss.sum()])

        total = _summed(packed, part, 3) / n
        return total[0], total[1:]

    line = lowest(scale, np.array([1.0, 0.0]), 12)
    return Model(weights, float(good), (max(float(line[0]), 1e-3), float(line[1])))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_lines, score, raw quality, and chances of good of the lines with a word, from `text` alone.

    A text without a word (null, empty, blank) gets the share of good training texts and no lines. Rows are judged one by one, so equal rows get equal
    scores; other columns are ignored; an empty table gives an empty table. Whole texts count, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = hashing.encoded(batch["text"])
            for begin, end in hashing.chunks(map(len, texts)):
                lines = Lines(texts[begin:end])
                good, mean = quality(lines.counts, lines.length, lines.features().astype(np.float32), model.weights)
                score = np.where(lines.counts > 0, 1 / (1 + np.exp(-(model.line[0] * _logit(mean) + model.line[1]))), model.prior)
                offsets = np.concatenate([[0], np.cumsum(lines.counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"][begin:end], pa.array(lines.counts), pa.array(score), pa.array(np.where(lines.counts > 0, mean, model.prior)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(good))], ["doc_id", "n_lines", "score", "raw", "line_good"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_lines long, score double, raw double, line_good array<double>")


def held_out(doc_id: Column) -> Column:
    """Every third document by the checksum of its id; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == HELD_OUT


def op13_quality_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter(~held_out(F.col("doc_id")))
    model = learn_quality(docs.select("doc_id", "text").join(labels, "doc_id"))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "raw")


QUERIES = {"op13_quality_crf": (op13_quality_crf, None)}
