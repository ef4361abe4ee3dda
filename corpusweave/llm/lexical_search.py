"""Ranked lexical search: an inverted index in segments, searched term-at-a-time first and document-at-a-time then.

Texts are indexed where they are read: a segment is the index of a few MB of texts, and no text is
shuffled. Segments are dealt over shards of a fixed number of words; a shard answers all queries of a
block with its best documents, and the best of all shards remain.

Within a shard a query's short lists are summed up term by term into one accumulator per document.
That table is then one more sorted list with a known largest value, beside the long lists. These
are walked document by document in ranges: a range, and within it a list or a candidate, is skipped
if the largest sums still possible cannot reach the last of the best scores so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm import hashing
from corpusweave.llm.storage import written

SEGMENT_BYTES = 4 << 20  # texts of a segment; one longer text is a segment of its own
SHARD_WORDS = 8_000_000
QUERY_BLOCK_BYTES = 4 << 20  # texts of queries that are searched together
SEED_SHARDS = 32  # one shard in so many is searched first, to learn what score a document needs
SHORT_POSTINGS = 4096  # postings of one query in one shard that are summed term by term
RANGE = 1024  # documents of a shard judged together
INDEX = "segment long, term string, n int, places binary, times binary, doc_ids array<long>, lengths array<long>"
FOUND = "query int, item_id long, doc_id long, score long, shard int, place int"
BEST = 10


def _blobs(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of a 32-bit array as one binary value each."""
    offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat, np.int32).tobytes())]).cast(pa.binary())


def segment_rows(segment: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    """Index of some texts: a row with ids and lengths, then a row per term with places and counts."""
    words = hashing.Words(texts, hashing.LETTERS_DIGITS, hashing.ASCII_LOWER)
    order = np.lexsort((words.text_of, words.hash))
    term, place = words.hash[order], words.text_of[order]
    first = np.ones(len(term), bool)
    first[1:] = (term[1:] != term[:-1]) | (place[1:] != place[:-1])
    pairs = np.flatnonzero(first)
    times = np.diff(np.append(pairs, len(term)))
    begins = np.flatnonzero(np.diff(term[pairs], prepend=~term[:1]) != 0) if len(pairs) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begins, len(pairs)))
    lower = hashing.ASCII_LOWER.tobytes()
    at = order[pairs[begins]]
    names = [words.raw[a:b].translate(lower).decode() for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
    n = len(names)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n + 1, segment)), pa.array([None, *names], pa.string()), pa.array(np.concatenate([[len(texts)], counts]), pa.int32()),
        pa.concat_arrays([pa.nulls(1, pa.binary()), _blobs(place[pairs], counts)]), pa.concat_arrays([pa.nulls(1, pa.binary()), _blobs(times, counts)]),
        pa.array([ids, *[None] * n], pa.list_(pa.int64())), pa.array([words.counts, *[None] * n], pa.list_(pa.int64()))],
        ["segment", "term", "n", "places", "times", "doc_ids", "lengths"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, ids, texts, held = TaskContext.get().partitionId() << 24, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), hashing.encoded(batch["text"])):
            if held and held + len(text) > SEGMENT_BYTES:
                yield segment_rows(number, ids, texts)
                number, ids, texts, held = number + 1, [], [], 0
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
    if ids:
        yield segment_rows(number, ids, texts)


@dataclass(frozen=True)
class Index:
    """`segments` as written, the number of documents with a word, and the number of all words."""

    segments: DataFrame
    documents: int
    words: int


def build_index(docs: DataFrame) -> Index:
    """The inverted index of all rows of `docs` (doc_id, text), kept in the shared folder.

    Words are `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. A null or wordless text is a document
    without words, which no search finds and no statistic counts; repeated rows are documents of their own; other columns
    are ignored. Within a segment words are told apart by 64 bits, between segments by their letters.
    """
    segments = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_segments, INDEX), "index")
    lengths = segments.filter("term is null").select("lengths")
    total = lengths.agg(F.sum(F.size(F.filter("lengths", lambda n: n > 0)).cast("long")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    return Index(segments, total[0] or 0, total[1] or 0)


class _Shard:
    """Lists of a shard's documents, with what a word adds to a score but for its weight."""

    def __init__(self, rows: pa.Table, documents: int, words: int):
        heads, lists, base = {}, {}, 0
        is_head = np.array([t is None for t in rows["term"].to_pylist()], bool)
        heads_table = rows.filter(pa.array(is_head)).sort_by("segment")
        ids, lengths = [], []
        for segment, n, own, length in zip(*(heads_table[c].to_pylist() for c in ("segment", "n", "doc_ids", "lengths"))):
            heads[segment] = base
            base += n
            ids += own
            lengths.append(np.array(length, np.int64))
        self.ids = ids
        size = np.concatenate([*lengths, np.zeros(0, np.int64)])
        # 100 - 75 + ((75 * n * N) div L), in whole numbers.
        self.m = 25 + (75 * size * documents) // max(words, 1)
        rest = rows.filter(pa.array(~is_head)).sort_by("segment")
        for segment, term, places, times in zip(*(rest[c].to_pylist() for c in ("segment", "term", "places", "times"))):
            lists.setdefault(term, []).append((np.frombuffer(places, np.int32) + heads[segment], np.frombuffer(times, np.int32)))
        self.edges = np.arange(0, base + RANGE, RANGE)
        self.lists = {}
        for term, parts in lists.items():
            at = np.concatenate([p for p, _ in parts])
            times = np.concatenate([t for _, t in parts]).astype(np.int64)
            self.lists[term] = self.listed(at, (1_000_000_000 * times) // (1000 * times + 8 * self.m[at]))

    def listed(self, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ascending places, their values, where each range begins, and the largest value of each range."""
        cut = np.searchsorted(at, self.edges)
        most = np.zeros(len(cut) - 1, np.int64)
        full = np.flatnonzero(cut[1:] > cut[:-1])
        if len(full):
            most[full] = np.maximum.reduceat(value, cut[full])
        return at, value, cut, most

    def _accumulated(self, short: list) -> tuple:
        """The short lists of a query as one list of sums."""
        at = np.concatenate([x[0][0] for x in short])
        value = np.concatenate([x[0][1] * x[1] for x in short])
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order]
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        return self.listed(at[begins], np.add.reduceat(value, begins))

    def best(self, query: dict[str, int], k: int, floor: int) -> list[tuple[int, int]]:
        """(score, place) of the `k` best documents above 0 and not below `floor`; equal scores by ascending id, nulls first."""
        own = sorted(((self.lists[t], w) for t, w in query.items() if w > 0 and t in self.lists), key=lambda x: len(x[0][0]))
        ends = np.cumsum([len(x[0][0]) for x in own])
        n_short = int(np.searchsorted(ends, SHORT_POSTINGS, side="right"))
        walked = ([(self._accumulated(own[:n_short]), 1)] if n_short else []) + own[n_short:]
        top: list[tuple[int, tuple[bool, int], int]] = []  # (-score, id with nulls first, place), ascending
        if not walked:
            return []
        bounds = np.stack([x[3] * w for x, w in walked])
        for r in range(len(self.edges) - 1):
            if bounds[:, r].sum() < max(floor, 1):
                continue
            order = np.argsort(bounds[:, r], kind="stable")
            below = np.cumsum(bounds[order, r])
            skipped = int(np.searchsorted(below, max(floor, 1)))  # documents in these lists only cannot do
            parts = []
            for i in order[skipped:]:
                (at, value, cut, _), w = walked[i]
                parts.append((at[cut[r] : cut[r + 1]], value[cut[r] : cut[r + 1]] * w))
            found = np.unique(np.concatenate([p for p, _ in parts]))
            score = np.zeros(len(found), np.int64)
            for at, value in parts:
                score[np.searchsorted(found, at)] += value
            for j in range(skipped - 1, -1, -1):
                able = score + below[j] >= floor
                found, score = found[able], score[able]
                (at, value, cut, _), w = walked[order[j]]
                at, value = at[cut[r] : cut[r + 1]], value[cut[r] : cut[r + 1]]
                if len(at) and len(found):
                    where = np.minimum(np.searchsorted(at, found), len(at) - 1)
                    score = score + np.where(at[where] == found, value[where] * w, 0)
            able = score >= max(floor, 1)
            if able.any():
                top += [(-s, (self.ids[p] is not None, self.ids[p] or 0), p) for s, p in zip(score[able].tolist(), found[able].tolist())]
                top = sorted(top)[:k]
                if len(top) == k:
                    floor = max(floor, -top[-1][0])
        return [(-s, p) for s, _, p in top]


def _searched(queries: list[tuple], floors: dict[int, int], index: tuple[int, int], k: int):
    """`queries`: (item_id, weights by word), numbered as they stand."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        shard = _Shard(rows, *index)
        out = []
        for number, (item_id, weights) in enumerate(queries):
            out += [(number, item_id, shard.ids[p], s, key[0].as_py(), p) for s, p in shard.best(weights, k, floors.get(number, 0))]
        columns = list(zip(*out)) or [[]] * 6
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "item_id", "doc_id", "score", "shard", "place"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "shard", "place")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(index: Index, items: DataFrame, k: int) -> DataFrame:
    """The best documents of the queries of one block, whose size is bounded."""
    rows = items.select("item_id", "terms").collect()
    vocabulary = items.select(F.explode(F.map_keys("terms")).alias("term")).distinct()
    lists = index.segments.join(vocabulary, "term", "left_semi")
    df = {r.term: r.df for r in lists.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1))) for t, n in df.items()}
    queries = [(r.item_id, {t: n * weight[t] for t, n in r.terms.items() if t in weight}) for r in rows]
    shards = max(1, -(-index.words // SHARD_WORDS))
    heads = index.segments.filter("term is null")
    dealt = lists.unionByName(heads.select(*lists.columns)).withColumn("shard", F.pmod(F.xxhash64("segment"), F.lit(shards)).cast("int"))
    size = (index.documents, index.words)

    def search(part: DataFrame, floors: dict[int, int]) -> DataFrame:
        return part.groupBy("shard").applyInArrow(_searched(queries, floors, size, k), FOUND)

    if shards < 2 * SEED_SHARDS:
        return _ranked(search(dealt, {}), k)
    # Scores of real documents: none that ranks lower than the k-th of these can be among the best.
    seed = written(search(dealt.filter(F.col("shard") % SEED_SHARDS == 0), {}), "search-seed")
    floors = {r.query: r.score for r in _ranked(seed, k).filter(F.col("rank") == k).select("query", "score").collect()}
    return _ranked(seed.unionByName(search(dealt.filter(F.col("shard") % SEED_SHARDS != 0), floors)), k)


def words_of(text):
    """The words of a column, as `build_index` takes them."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def search(index: Index, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the `k` best documents for each row of `items` (item_id, text).

    A word weighs w = floor(1000 * ln((2N + 2) / (2 df + 1))); a document's score is the sum of
    w * ((10^9 tf) div (1000 tf + 8 m)), m = 25 + (75 n N div L), over the item's words, repeats included. Only scores above 0
    count; equal scores go by ascending doc_id, a null id first. Items without words, with unknown words only or with a null
    text get no rows; items equal in id and text are one; other columns are ignored; empty tables give no rows.

    Items are taken in blocks of about QUERY_BLOCK_BYTES of text, which every task is given; all else is spread over shards.
    """
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BLOCK_BYTES))
    terms = own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")).withColumn("word", F.explode(words_of(F.col("text"))))
    counted = terms.groupBy("block", "item_id", "text", "word").agg(F.count("*").alias("n"))
    bags = written(counted.groupBy("block", "item_id", "text").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("terms")), "queries")
    out = None
    for block in range(blocks):
        found = _block(index, bags.filter(F.col("block") == block).orderBy("item_id", "text"), k)
        out = found if out is None else out.unionByName(found)
    return out.select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, {_WORDS.format('text')} AS words FROM documents WHERE text IS NOT NULL),
sized AS (SELECT row_no, doc_id, len(words) AS n FROM docs WHERE len(words) > 0),
total AS (SELECT count(*) AS docs_n, sum(n)::BIGINT AS words_n FROM sized),
asked AS (SELECT row_number() OVER () AS item_no, item_id, {_WORDS.format('text')} AS words FROM benchmark WHERE text IS NOT NULL),
asked_words AS (SELECT item_no, item_id, word, count(*) AS times FROM (SELECT item_no, item_id, unnest(words) AS word FROM asked) GROUP BY ALL),
counted AS (SELECT row_no, word, count(*) AS tf FROM (SELECT row_no, unnest(words) AS word FROM docs) WHERE word IN (SELECT word FROM asked_words) GROUP BY ALL),
weights AS (SELECT word, floor(1000 * ln((2 * docs_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, total GROUP BY word, docs_n),
scored AS (
  SELECT a.item_no, a.item_id, s.row_no, s.doc_id,
         sum(a.times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * docs_n) // words_n)))))::BIGINT AS score
  FROM asked_words a JOIN counted c USING (word) JOIN weights USING (word) JOIN sized s ON s.row_no = c.row_no, total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS FIRST, row_no)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {"op12_lexical_search": (op12_lexical_search, ORACLE)}
