"""Shortest chains of many pairs in a graph small enough for every task: numpy searches from both ends of a batch of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_ROWS = 1 << 20  # that a step of a batch may reach; a batch of one pair may reach all edges
PAIRS = 1 << 10  # of a batch


class Graph:
    """Edges (src, dst) with nodes as their places in text order: `begins` and `ends` list what follows a node, and what goes before it."""

    def __init__(self, edges: pa.Table):
        src, dst = edges["src"], edges["dst"]
        both = pa.chunked_array([*src.chunks, *dst.chunks], src.type).unique()
        self.names = both.take(pc.sort_indices(both))
        a, b = (pc.index_in(x, value_set=self.names).to_numpy().astype(np.int32) for x in (src, dst))
        self.begins, self.ends = [], []
        for x, y in ((a, b), (b, a)):
            order = np.lexsort((y, x))
            self.begins.append(np.searchsorted(x[order], np.arange(len(self.names) + 1)))
            self.ends.append(y[order])


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every run, one run after the other."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def search(graph: Graph, source: np.ndarray, target: np.ndarray, max_depth: int | None = None, most: int = MOST_ROWS) -> tuple[int, Iterator[np.ndarray]] | None:
    """The most rows of a step, and nodes of the chains, a chain a row, those of one length together; None if several pairs reach more than `most` rows in a step.

    Each distinct source and target is searched once. A ring has a row per search and node, as search * n + node. That from sources
    is in order of chains, so that the first way to a node is the first in text order; that from targets is in order of nodes, by which chains start.
    """
    n = len(graph.names)
    starts = [np.unique(x).astype(np.int64) for x in (source, target)]
    at = [np.searchsorted(s, x) for s, x in zip(starts, (source, target))]
    rings = [np.arange(len(s)) * n + s for s in starts]
    seen, levels = [[r] for r in rings], [[(s, None)] for s in starts]
    ordered, row = rings[0], np.arange(len(starts[0]))  # the ring from sources by node, and the rows of it
    left, depth, largest, found = np.arange(len(source)), 0, 0, []
    while len(left) and (max_depth is None or depth < max_depth):
        depth += 1
        live, sizes = [], []
        for side in (0, 1):
            wanted = np.zeros(len(starts[side]), bool)
            wanted[at[side][left]] = True
            live.append(np.flatnonzero(wanted[rings[side] // n]))
            node = rings[side][live[side]] % n
            sizes.append(graph.begins[side][node + 1] - graph.begins[side][node])
        side = int(sizes[1].sum() < sizes[0].sum())  # the one with less to do
        rows, size = live[side], sizes[side]
        largest = max(largest, int(size.sum()))
        if largest > most and len(source) > 1:
            return None
        ring = rings[side][rows]
        node = ring % n
        keys = np.repeat(ring - node, size) + graph.ends[side][_runs(graph.begins[side][node], size)]
        keys, first = np.unique(keys, return_index=True)
        for run in seen[side]:
            fresh = run[np.minimum(np.searchsorted(run, keys), len(run) - 1)] != keys
            keys, first = keys[fresh], first[fresh]
        if len(keys):
            seen[side].append(keys)
        while len(seen[side]) > 1 and len(seen[side][-2]) <= 2 * len(seen[side][-1]):  # few runs, each merged seldom
            seen[side][-2:] = [np.sort(np.concatenate(seen[side][-2:]), kind="stable")]
        if side == 0:
            order = np.argsort(first)
            ordered, row = keys, np.empty(len(keys), np.int64)
            row[order] = np.arange(len(keys))
            keys, first = keys[order], first[order]
        rings[side] = keys
        levels[side].append((keys % n, np.repeat(rows, size)[first]))
        met, heads, tails = _met(n, rings, ordered, row, at[0][left], at[1][left], most)
        if len(met):
            found.append((len(levels[0]), len(levels[1]), heads, tails))
        # A pair is given up once the search from either of its ends has run dry.
        going = np.zeros(len(starts[side]), bool)
        going[keys // n] = True
        going = going[at[side][left]]
        going[met] = False
        left = left[going]
    return largest, (_chains(levels, up, down, heads[k : k + step], tails[k : k + step]) for up, down, heads, tails in found
                     for step in [max(1, most // (up + down))] for k in range(0, len(heads), step))


def _met(n: int, rings: list, ordered: np.ndarray, row: np.ndarray, head: np.ndarray, tail: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs (search from the source, from the target) whose rings share a node, and both rows of it; of several nodes that whose chain from the source is first."""
    bounds = [np.searchsorted(ring // n, np.arange(ends.max() + 2)) for ring, ends in zip(rings, (head, tail))]
    begins = [b[k] for b, k in zip(bounds, (head, tail))]
    sizes = [b[k + 1] - b[k] for b, k in zip(bounds, (head, tail))]
    side = int(sizes[1].sum() < sizes[0].sum())  # whose rows are looked up in the other ring
    other, known = (tail, rings[1]) if side == 0 else (head, ordered)
    if not len(known) or not sizes[side].any():
        return (np.zeros(0, np.int64),) * 3
    parts, total = [], np.cumsum(sizes[side])
    for cut in np.split(np.arange(len(head)), np.unique(np.searchsorted(total, np.arange(most, total[-1], most)))):
        rows = _runs(begins[side][cut], sizes[side][cut])
        keys = np.repeat(other[cut] * n, sizes[side][cut]) + rings[side][rows] % n
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = np.flatnonzero(known[place] == keys)
        parts.append((np.repeat(cut, sizes[side][cut])[hit], *((rows[hit], place[hit]) if side == 0 else (row[place[hit]], rows[hit]))))
    pair, heads, tails = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((heads, pair))
    pair, heads, tails = pair[order], heads[order], tails[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[first], heads[first], tails[first]


def _chains(levels: list, up: int, down: int, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Nodes of the chains through rows of the last of the first `up` rings from sources and `down` rings from targets, a chain a row."""
    out = np.empty((len(heads), up + down - 1), np.int64)
    for k in range(up - 1, -1, -1):
        nodes, above = levels[0][k]
        out[:, k] = nodes[heads]
        heads = above[heads] if k else heads
    for k in range(down - 1, 0, -1):
        tails = levels[1][k][1][tails]
        out[:, up + down - 1 - k] = levels[1][k - 1][0][tails]
    return out


def chain_rows(held, max_depth: int | None = None):
    """Rows (source, target, chain) of those pairs of batches (source, target) that a chain joins; `held` is a broadcast `Graph`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, size = held.value, PAIRS
        for batch in batches:
            ends = [pc.index_in(batch[c], value_set=graph.names) for c in ("source", "target")]
            there = pc.and_(*map(pc.is_valid, ends))
            source, target = (e.filter(there).to_numpy().astype(np.int64) for e in ends)
            begin = 0
            while begin < len(source):
                got = search(graph, source[begin : begin + size], target[begin : begin + size], max_depth)
                if got is None:
                    size = max(1, size // 2)
                    continue
                begin += size
                size = min(PAIRS, size * 2) if got[0] * 4 < MOST_ROWS else size
                for chains in got[1]:
                    offsets = np.arange(0, chains.size + 1, chains.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([
                        graph.names.take(pa.array(chains[:, 0])), graph.names.take(pa.array(chains[:, -1])),
                        pa.ListArray.from_arrays(pa.array(offsets), graph.names.take(pa.array(chains.ravel())))], ["source", "target", "chain"])

    return run
