"""N-gram Jaccard join with signature trees.

1. Documents with the same shingle set form a class; one of them stands for it.
2. A set that links to another misses at most a quarter of its shingles there, so the smallest shared hash is among the
   first quarter (and one) of both. All sets ask about these, and about all hashes
   under a fixed bound; a set with more than a quarter of its shingles among the latter that no other has is out. Whether a shingle is shared is asked as in `repeats`.
3. The others are compared in blocks that share a shingle, each by a tree whose nodes
   hold OR-combined bitmaps and size ranges; pairs of nodes are visited together and left when no pair below can overlap enough.
4. Comparing stops inside what is already linked. Two rounds take one block for each document, split into tiles. The last takes every
   shingle that still stands in two components, so no link is lost; its trees hold bitmaps alone and join what may
   overlap enough into loose groups. Only within those are whole sets compared once more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import hashing
from corpusweave.llm.components import components
from corpusweave.llm.repeats import ASK, GROUPS_PER_PARTITION, BUCKETS_PER_PARTITION, Question, answered
from corpusweave.llm.storage import written

BITS = 4096
LEAF, FANOUT = 64, 4
TILE, BITMAP_TILE = 256, 2048  # documents compared in one task by whole sets, and by bitmaps of 512 bytes
ASKED = 0.75  # every set asks about this share of all possible hashes, so among those "not shared" is certain
SETS = "doc_id long, row_key long, n_shingles long, low long, high long"
LEFT_OVER = "row_key long, n int, bits binary, load int, shingles array<long>, shared array<long>"
EDGES = "a long, b long"


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text is one shingle, one without words has none."""
    out: list[np.ndarray] = []
    for begin, end in hashing.chunks(map(len, texts)):
        words = hashing.Words(texts[begin:end], hashing.SPACED, hashing.ASCII_LOWER)
        starts, prints = words.windows(size)
        bounds = np.searchsorted(starts, words.first)
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))
        whole = hashing.range_hashes(hashing.prefix_sums(words.hash), words.first[short], words.first[short + 1])
        single = dict(zip(short.tolist(), whole))
        for k in range(end - begin):
            out.append(np.array([single[k]], np.uint64) if k in single else np.unique(prints[bounds[k] : bounds[k + 1]]))
    return out


def may_miss(n: int, percent: int) -> int:
    """How many of n shingles a linked document may lack."""
    return n - -(-n * percent // 100)


class _Node:
    def __init__(self, members: list[int], children: list, tree: "SignatureTree"):
        self.members, self.children = members, children
        parts = [c.bits for c in children] or [tree.bits[m] for m in members]
        self.bits = np.bitwise_or.reduce(parts)
        self.every = np.bitwise_and.reduce([c.every for c in children] or parts)
        sizes = [tree.sizes[m] for m in members]
        self.least, self.most = min(sizes), max(sizes)
        self.load = max(tree.loads[m] for m in members)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmap of a set, and how many shingles share its fullest bit."""
    slots = np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits(slots > 0).view(np.uint64), int(slots.max(initial=1))


class SignatureTree:
    """Bitmaps of shingle sets in a hierarchy: leaves hold a few sets of like size, a node the OR of its children."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], loads: list[int], percent: int, sets: list[np.ndarray] | None = None):
        self.sizes, self.bits, self.loads, self.percent, self.sets = sizes, bits, loads, percent, sets
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], bits[k].tobytes()))
        level = [_Node(order[k : k + LEAF], [], self) for k in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [_Node([m for c in level[k : k + FANOUT] for m in c.members], level[k : k + FANOUT], self) for k in range(0, len(level), FANOUT)]
        self.root = level[0]
        self.above = list(range(len(sizes)))

    def find(self, k: int) -> int:
        while self.above[k] != k:
            self.above[k] = k = self.above[self.above[k]]
        return k

    def _hopeless(self, a: _Node, b: _Node) -> bool:
        """No pair below can link: sizes are too far apart, or the largest possible overlap is too small."""
        p = self.percent
        if 100 * a.most < p * b.least or 100 * b.most < p * a.least:
            return True
        common = int(np.bitwise_count(a.bits & b.bits).sum()) * min(a.load, b.load)
        overlap = min(a.most, b.most, common, a.most - int(np.bitwise_count(a.every & ~b.bits).sum()), b.most - int(np.bitwise_count(b.every & ~a.bits).sum()))
        return overlap * (100 + p) < p * (a.least + b.least)  # overlap / (sum of sizes - overlap) stays below

    def _possible(self, a: _Node, b: _Node, apart: list | None) -> list[tuple[int, int]]:
        """Pairs of two leaves, of different components, whose bitmaps allow a link."""
        x, y = (np.stack([self.bits[m] for m in n.members]) for n in (a, b))
        nx, ny = (np.array([self.sizes[m] for m in n.members]) for n in (a, b))
        both = nx[:, None] - np.bitwise_count(x[:, None] & ~y[None]).sum(2, dtype=np.int64)
        both = np.minimum(both, ny - np.bitwise_count(~x[:, None] & y[None]).sum(2, dtype=np.int64))
        may = both * (100 + self.percent) >= self.percent * (nx[:, None] + ny)
        rx, ry = (np.array([self.find(m) for m in n.members]) for n in (a, b))
        may &= rx[:, None] != ry
        if apart is not None:
            may &= np.array([apart[m] for m in a.members])[:, None] != np.array([apart[m] for m in b.members])
        return [(a.members[i], b.members[j]) for i, j in np.argwhere(np.triu(may) if a is b else may)]

    def linked(self, i: int, j: int) -> bool:
        """Whether two sets whose bitmaps allow it do link; without the sets there is no more to ask."""
        if self.sets is None:
            return True
        x, y = sorted((self.sets[i], self.sets[j]), key=len)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        same = int((y[at] == x).sum())
        return 100 * same >= self.percent * (len(x) + len(y) - same)

    def links(self, start: list | None = None, apart: list | None = None) -> list[tuple[int, int]]:
        """Links that join components not joined before. `start` gives components known already; with `apart`, only
        sets on different sides of it are compared."""
        first: dict = {}
        for k, label in enumerate(start or []):
            self.above[k] = first.setdefault(label, k)
        out, todo = [], [(self.root, self.root)]
        while todo:
            a, b = todo.pop()
            if self._hopeless(a, b):
                continue
            roots = {self.find(m) for m in a.members} | ({self.find(m) for m in b.members} if b is not a else set())
            if len(roots) == 1:
                continue
            if a.children or b.children:
                if a is b:
                    todo += [(x, y) for k, x in enumerate(a.children) for y in a.children[k:]]
                elif a.children and (len(a.members) >= len(b.members) or not b.children):
                    todo += [(x, b) for x in a.children]
                else:
                    todo += [(a, y) for y in b.children]
                continue
            for i, j in self._possible(a, b, apart):
                x, y = self.find(i), self.find(j)
                if x != y and self.linked(i, j):
                    self.above[max(x, y)] = min(x, y)
                    out.append((i, j))
        return out


def _links_of(tree: SignatureTree, table: pa.Table) -> pa.Table:
    keys, sides = table["row_key"].to_pylist(), table["side"].to_pylist()
    found = tree.links(table["root"].to_pylist(), sides if len(set(sides)) > 1 else None)
    return pa.table({"a": pa.array([keys[i] for i, _ in found], pa.int64()), "b": pa.array([keys[j] for _, j in found], pa.int64())})


def _set_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        flat = table["shingles"].combine_chunks()
        offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)
        sets = [values[a:b] for a, b in zip(offsets, offsets[1:])]
        bits, loads = zip(*map(signature, sets))
        return _links_of(SignatureTree([len(x) for x in sets], list(bits), list(loads), percent, sets), table)

    return run


def _bitmap_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        bits = [np.frombuffer(x, np.uint64) for x in table["bits"].to_pylist()]
        return _links_of(SignatureTree(table["n"].to_pylist(), bits, table["load"].to_pylist(), percent), table)

    return run


def _compare(routed: DataFrame, sets: DataFrame, percent: int, loosely: bool = False) -> DataFrame:
    """Links inside each (block, tile) of `routed` (block, tile, side, row_key, root), by whole sets or by bitmaps."""
    sizes = routed.groupBy("block", "tile").agg(F.count("*").alias("members"), F.min("root").alias("r"), F.max("root").alias("s"))
    useful = routed.join(sizes.filter("members > 1 and r <> s").select("block", "tile"), ["block", "tile"])
    full = useful.join(sets.select("row_key", *(["n", "bits", "load"] if loosely else ["shingles"])), "row_key")
    return full.groupBy("block", "tile").applyInArrow((_bitmap_links if loosely else _set_links)(percent), EDGES)


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows (block, row_key, root), each in one tile of its block; a tile has about TILE rows."""
    sizes = rows.groupBy("block").agg(F.count("*").alias("members"))
    tiles = F.ceil(F.col("members") / TILE)
    return rows.join(sizes.filter("members > 1"), "block").select(
        "block", F.pmod(F.xxhash64("row_key"), tiles).cast("int").alias("tile"), F.lit(0).alias("side"), "row_key", "root")


def _paired(rows: DataFrame, tile: int) -> DataFrame:
    """Rows in all pairs of tiles of their block, so that any two rows of a block meet."""
    sizes = rows.groupBy("block").agg(F.count("*").alias("members"))
    tiles = F.ceil(F.col("members") / tile).cast("int")
    own = rows.join(sizes.filter("members > 1"), "block").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("row_key"), tiles).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return met.select("block", (F.least("own", "other") * F.col("tiles") + F.greatest("own", "other")).alias("tile"), F.col("own").alias("side"), "row_key", "root")


class _Tables:
    """The steps up to the sets that may link at all."""

    def __init__(self, docs: DataFrame, percent: int, size: int):
        spark = docs.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        groups, buckets = parts * GROUPS_PER_PARTITION, max(1, int(parts * BUCKETS_PER_PARTITION))
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("row_key"))

        def signed(batches):
            for batch in batches:
                sets = shingle_sets(hashing.encoded(batch["text"]), size)
                low = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                high = np.array([hashing.mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["row_key"], pa.array([len(s) for s in sets], pa.int64()), pa.array(low.view(np.int64)), pa.array(high.view(np.int64))],
                    ["doc_id", "row_key", "n_shingles", "low", "high"])

        self.sets = written(keyed.select("doc_id", "row_key", "text").mapInArrow(signed, SETS), "sets")
        same = ["n_shingles", "low", "high"]
        self.classes = self.sets.filter("n_shingles > 0").groupBy(*same).agg(F.min("row_key").alias("chosen"), F.min("doc_id").alias("first_doc"))
        place = lambda c: F.pmod(F.col(c), F.lit(groups)).cast("int")
        texts = keyed.select("row_key", "text").withColumn("group", place("row_key")).repartition(parts, "group")
        nothing = F.lit(None)
        chosen = self.classes.select(place("chosen").alias("to_group"), F.col("chosen").alias("about"), nothing.cast("int").alias("bucket"), nothing.cast("binary").alias("flags"))

        def sets_of(table: pa.Table, said: pa.Table) -> dict[int, np.ndarray]:
            use = set(said["about"].drop_null().to_pylist())
            texts = {k: t for k, t in zip(table["row_key"].to_pylist(), hashing.encoded(table["text"])) if k in use}
            return dict(sorted(zip(texts, shingle_sets(list(texts.values()), size))))

        def sampled(s: np.ndarray) -> int:
            return int(np.searchsorted(s, np.uint64(int(ASKED * 2**64))))

        def head(s: np.ndarray) -> np.ndarray:
            return s[: max(may_miss(len(s), percent) + 1, sampled(s))]

        def ask(key, table: pa.Table, said: pa.Table) -> pa.Table:
            sets = sets_of(table, said)
            return Question([head(s) for s in sets.values()]).ask(key[0].as_py(), buckets)

        def kept(key, table: pa.Table, said: pa.Table) -> pa.Table:
            sets = sets_of(table, said)
            answers = {b: f for b, f in zip(said["bucket"].to_pylist(), said["flags"].to_pylist()) if b is not None}
            heads = [head(s) for s in sets.values()]
            flags = Question(heads).hear(answers, buckets)
            rows, at = [], 0
            for (row_key, s), h in zip(sets.items(), heads):
                shared, miss = flags[at : at + len(h)], may_miss(len(s), percent)
                at += len(h)
                # Shingles known to be no other set's come first in the order of all, so fewer shared ones need blocks.
                own = int((~shared[: sampled(s)]).sum())
                beyond = np.flatnonzero(shared | (np.arange(len(h)) >= sampled(s)))[: max(0, miss + 1 - own)]
                if shared[beyond].any():
                    bits, load = signature(s)
                    rows.append((row_key, len(s), bits.tobytes(), load, s.view(np.int64), h[beyond[shared[beyond]]].view(np.int64)))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row_key", "n", "bits", "load", "shingles", "shared"])

        meet = lambda told: texts.groupBy("group").cogroup(told.groupBy("to_group"))
        told = answered(meet(chosen).applyInArrow(ask, ASK)).select(F.col("group").alias("to_group"), nothing.cast("long").alias("about"), "bucket", "flags")
        self.left = written(meet(chosen.unionByName(told)).applyInArrow(kept, LEFT_OVER), "left")


def jaccard_components(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, row_key (xxhash64 of doc_id and text), root_key: documents linked by equal shingles, 100 * shared >= percent * union.

    Words are runs of anything but ASCII white space after A-Z are lower-cased; a text of fewer than `size` words is one shingle; null and
    blank texts have none and link with nothing, so each is its own component. component_id is the
    smallest doc_id that links reach, and null or shared by components where ids are; root_key is a row_key of the component and tells
    components apart whatever their ids. Equal rows link, an empty table gives an empty table, other columns are ignored.
    """
    tables = _Tables(docs, percent, size)
    left = tables.left
    alone = left.select("row_key", F.col("row_key").alias("root"), F.array_min("shared").alias("block"))
    links = written(_compare(_tiled(alone), left, percent), "near")

    def labelled(links: DataFrame) -> DataFrame:
        return left.select("row_key", "shared").join(components(links), F.col("row_key") == F.col("node"), "left").select("row_key", "shared", F.coalesce("root", "row_key").alias("root"))

    def open_shingles(now: DataFrame) -> DataFrame:
        """block, row_key, root for shingles in two components or more; of those with the same documents, one is enough."""
        each = now.select("row_key", "root", F.explode("shared").alias("block"))
        blocks = each.groupBy("block").agg(
            F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("m"), F.sum(F.xxhash64("row_key").cast("decimal(38,0)")).alias("who")
        ).filter("r <> s").groupBy("m", "who").agg(F.min("block").alias("block"))
        return written(each.join(blocks.select("block"), "block").select("block", "row_key", "root"), "open")

    again = open_shingles(labelled(links)).groupBy("row_key", "root").agg(F.min(F.struct(F.xxhash64("block", F.lit(2)).alias("h"), "block")).alias("x"))
    links = written(links.union(_compare(_tiled(again.select(F.col("x.block").alias("block"), "row_key", "root")), left, percent)), "near")
    now = written(labelled(links), "labels")
    # A loose link stands for the whole components of its ends, so these come along.
    loose = components(links.union(_compare(_paired(open_shingles(now), BITMAP_TILE), left, percent, loosely=True)))
    grouped = now.join(loose.withColumnRenamed("root", "block"), F.col("row_key") == F.col("node")).select("block", "row_key", "root")
    several = grouped.groupBy("block").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("block")
    last = written(grouped.join(several, "block"), "last")
    links = links.union(_compare(_paired(last, TILE), left, percent))
    roots = components(links).select(F.col("node").alias("chosen"), "root")
    classes = tables.classes.join(roots, "chosen", "left").withColumn("root", F.coalesce("root", "chosen"))
    smallest = classes.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = classes.join(smallest, "root").select("n_shingles", "low", "high", "component_id", "root")
    out = tables.sets.join(named, ["n_shingles", "low", "high"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row_key",
                      F.coalesce("root", "row_key").alias("root_key"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key", "root_key")


QUERIES = {"op6_jaccard_join": (op6_jaccard_join, None)}
