"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

A chromosome is a list of bins. Crossover puts whole well-filled bins of one parent into
the other, takes out the bins that hold one of those items twice, and best-fits the items set free, largest first.
Items are dealt over groups; each group evolves on several islands, which send their
best packing to the next island between epochs. Poorly filled bins of all groups are opened
and their items packed again together, level by level, until one group is left or a level fills hardly any bin.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.storage import written

END_ID = 2
GROUP_ITEMS = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 6, 3
FULL_ENOUGH = 0.97
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class PieceEncoder(dict):
    """Token ids (little-endian 32 bits) of a text; as a dict, those of a space and the key.

    A space after a non-space always begins a new token, so texts without two white spaces in a row are encoded
    word by word, and words are remembered, up to a bounded number. Texts that hold the name of a
    special token go to the `tokenizers` library, which gives the same ids for all others.
    """

    MOST = 200_000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            kept = json.load(file)
        special = [t["content"] for t in kept["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in kept["model"]["vocab"].items() if token not in special}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self._plain = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._whole = Tokenizer.from_file(path)
        self._special, self._spaces = special, re.compile(r"\s\s")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.MOST:
            self.clear()
        ids = self[word] = np.array(self._plain.encode_ordinary(" " + word), "<u4").tobytes()
        return ids

    def encoded(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self._spaces.search(text):
            return np.array(self._plain.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self._plain.encode_ordinary(first), "<u4").tobytes() + b"".join([self[w] for w in rest])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32.

    A document is the ids of its text and id 2. Only a document longer than `capacity` is cut; then
    the first piece may be shorter. A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = PieceEncoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encoder.encoded(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put items, largest first, each into the fullest bin with room; `bins` is changed and returned."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_sizes = 0  # bit r is set if a bin has room r
    for k, members in enumerate(bins):
        left = capacity - sum(sizes[i] for i in members)
        room[left].append(k)
        open_sizes |= 1 << left
    for i in sorted(items, key=lambda i: -sizes[i]):
        fits = open_sizes >> sizes[i]
        if fits:
            left = sizes[i] + (fits & -fits).bit_length() - 1
            k = room[left].pop()
            if not room[left]:
                open_sizes &= ~(1 << left)
            bins[k].append(i)
        else:
            k, left = len(bins), capacity
            bins.append([i])
        left -= sizes[i]
        room[left].append(k)
        open_sizes |= 1 << left
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those with fuller and emptier ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(taker: list[list[int]], giver: list[list[int]], sizes: list[int], capacity: int, chance: random.Random) -> list[list[int]]:
    """Some well-filled bins of `giver` go whole into `taker`; what they displace is best-fitted."""
    full = [b for b in giver if sum(sizes[i] for i in b) >= FULL_ENOUGH * capacity]
    chosen = chance.sample(full, min(len(full), 1 + len(giver) // 4))
    given = {i for b in chosen for i in b}
    kept, free = [list(b) for b in chosen], []
    for b in taker:
        if given.isdisjoint(b):
            kept.append(list(b))
        else:
            free += [i for i in b if i not in given]
    loose = sorted(kept, key=lambda b: sum(sizes[i] for i in b))[: 2 + len(kept) // 50]  # open the emptiest bins too
    opened = {id(b) for b in loose}
    free += [i for b in loose for i in b]
    return best_fit(free, sizes, [b for b in kept if id(b) not in opened], capacity)


def evolve(population: list, sizes: list[int], capacity: int, generations: int, chance: random.Random) -> list:
    for _ in range(generations):
        if len(population) < 2 or -fitness(population[0], sizes, capacity)[0] * capacity - sum(sizes) < capacity:
            break  # no packing has fewer bins
        a, b = chance.sample(population, 2)
        population = sorted([*population, crossover(a, b, sizes, capacity, chance)], key=lambda p: fitness(p, sizes, capacity), reverse=True)[:POPULATION]
    return population


def _founders(sizes: list[int], capacity: int, chance: random.Random) -> list:
    items = list(range(len(sizes)))
    out = [best_fit(items, sizes, [], capacity)]
    for _ in range(POPULATION - 1):
        first = chance.sample(items, len(items) // 8)  # a random start gives the population other bins
        begun = []
        for i in first:
            if begun and sum(sizes[j] for j in begun[-1]) + sizes[i] <= capacity:
                begun[-1].append(i)
            else:
                begun.append([i])
        seen = set(first)
        out.append(best_fit([i for i in items if i not in seen], sizes, begun, capacity))
    return sorted(out, key=lambda p: fitness(p, sizes, capacity), reverse=True)


def _pack_groups(items: DataFrame, groups: int, capacity: int, seed: int) -> DataFrame:
    """uid, length, pack_group, bin, fill: the best packing that the islands of each group found."""
    place = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups)).cast("int")
    dealt = items.select("uid", "length", place.alias("pack_group"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    rows = "pack_group int, island int, uid long, length long, bin int, fill long"

    def island(key, here: pa.Table, elite: pa.Table | None) -> pa.Table:
        here = here.sort_by("uid")
        sizes, n = here["length"].to_pylist(), here.num_rows
        chance = random.Random(f"{seed} {key[0].as_py()} {key[1].as_py()}")
        population = _founders(sizes, capacity, chance) if n else []
        if elite is not None and elite.num_rows:
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(elite.sort_by("uid")["bin"].to_pylist()):
                bins.setdefault(b, []).append(i)
            population = sorted([*population, list(bins.values())], key=lambda p: fitness(p, sizes, capacity), reverse=True)
        best = evolve(population, sizes, capacity, GENERATIONS, chance)[0] if n else []
        bin_of, fill = np.zeros(n, np.int32), np.zeros(n, np.int64)
        for k, members in enumerate(best):
            bin_of[members], fill[members] = k, sum(sizes[i] for i in members)
        return pa.table({"pack_group": here["pack_group"], "island": here["island"], "uid": here["uid"], "length": here["length"],
                         "bin": pa.array(bin_of), "fill": pa.array(fill)})

    packed = dealt.groupBy("pack_group", "island").applyInArrow(lambda key, here: island(key, here, None), rows)
    for _ in range(EPOCHS - 1):
        to = F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")
        moved = packed.select(F.col("pack_group").alias("g"), to.alias("to"), F.col("uid"), F.col("bin"))
        packed = dealt.groupBy("pack_group", "island").cogroup(moved.groupBy("g", "to")).applyInArrow(island, rows)
    scores = packed.groupBy("pack_group", "island").agg(F.max("bin").alias("bins"), F.sum("fill").alias("filled"))
    best = scores.groupBy("pack_group").agg(F.min(F.struct("bins", -F.col("filled"), "island")).alias("best"))
    winner = best.select("pack_group", F.col("best.island").alias("island"))
    return packed.join(winner, ["pack_group", "island"]).select("uid", "length", "pack_group", "bin", "fill")


def pack(pieces: DataFrame, capacity: int = 1024, group_items: int = GROUP_ITEMS) -> DataFrame:
    """`pieces` (length and any columns) with sequence_id and offset.

    Pieces of the full capacity are sequences by themselves. The others are packed in groups of about
    `group_items`; bins under 97 % full are opened and packed again over all groups, until a level fits in one group or
    leaves over 90 % of its pieces in such bins; then the bins of all its groups stay as they are.
    Offsets follow each other without gaps. Pieces of equal length are exchangeable. An empty
    table gives an empty table.
    """
    numbered = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    rest = numbered.filter(F.col("length") < capacity).select("uid", "length")
    placed, level = [], 0
    while True:
        n = rest.count()
        if n == 0:
            break
        groups = -(-n // group_items)
        packed = written(_pack_groups(rest, groups, capacity, level), f"packed{level}")
        poor = packed.filter(F.col("fill") < FULL_ENOUGH * capacity)
        last = groups == 1 or poor.count() > 0.9 * n  # long items only: no use in packing them yet again
        good = packed if last else packed.filter(F.col("fill") >= FULL_ENOUGH * capacity)
        number = F.lit(level) * (1 << 56) + F.col("pack_group").cast("long") * (1 << 20) + F.col("bin")
        placed.append(good.select("uid", number.alias("sequence_id")))
        if last:
            break
        rest, level = poor.select("uid", "length"), level + 1
    full = numbered.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    out = full.drop("uid")
    if placed:
        every = placed[0]
        for more in placed[1:]:
            every = every.unionByName(more)
        mates = every.join(numbered, "uid").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("mates"))
        runs = mates.select("sequence_id", F.explode(F.transform("mates", lambda m: F.struct(
            m["uid"].alias("uid"),
            F.aggregate(F.filter("mates", lambda x: x["uid"] < m["uid"]), F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("offset")))).alias("m"))
        out = out.unionByName(runs.select("sequence_id", "m.uid", "m.offset").join(numbered, "uid").drop("uid"))
    return out


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op10_best_fit_packing": (op10_best_fit_packing, None)}
