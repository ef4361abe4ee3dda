"""Signature-tree join against all pairs, with groups around the threshold."""

import random
import re

from corpusweave.llm.jaccard_join import SignatureTree, jaccard_components, signature

import numpy as np


def brute(docs):
    sets = {}
    for doc_id, text in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    chance = random.Random(seed)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(4))
    docs, shared = [], [word() for _ in range(60)]
    for size in (6, 9, 30, 120, 120, 300):
        base = [word() for _ in range(size)]
        for _ in range(22):
            w = list(base)
            for _ in range(chance.randrange(0, 1 + size // 12)):
                w[chance.randrange(len(w))] = word()
            docs.append(w[: len(w) - chance.randrange(0, 1 + size // 6)])
    docs += [[word() for _ in range(100)] + shared for _ in range(40)]  # one passage in many documents
    return [(k, " ".join(w)) for k, w in enumerate(docs)]


def test_components_equal_all_pairs(spark):
    odd = [(900, None), (901, ""), (902, " \n"), (903, "Two words"), (904, "two WORDS"), (905, "one"), (906, "x " * 5000)]
    for seed in (1, 2):
        docs = corpus(seed) + odd
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row_key", "'x' as root")
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
        assert got == brute(docs)


def test_equal_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert {r.component_id for r in jaccard_components(df).collect()} == {2}
    assert jaccard_components(df.limit(0)).collect() == []


def test_bitmaps_alone_never_lose_a_link():
    chance = np.random.default_rng(3)
    base = np.unique(chance.integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([chance.choice(base, 300, replace=False), chance.integers(0, 2**63, k).astype(np.uint64)])) for k in range(60)]
    bits, loads = zip(*map(signature, sets))
    exact = SignatureTree([len(s) for s in sets], list(bits), list(loads), 60, sets)
    loose = SignatureTree([len(s) for s in sets], list(bits), list(loads), 60)
    exact.links(), loose.links()
    for i in range(60):
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j]))
            if 100 * same >= 60 * (len(sets[i]) + len(sets[j]) - same):
                assert exact.find(i) == exact.find(j) and loose.find(i) == loose.find(j)
