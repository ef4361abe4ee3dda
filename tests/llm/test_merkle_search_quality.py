"""Merkle manifest, lexical search and line CRF on null, empty, long, repeated and tied rows, by brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.llm import lexical_search, line_quality_crf as crf
from corpusweave.llm.merkle_manifest import build_manifest, folded, leaf_digest, op11_merkle_manifest

H = lambda s: sha256(s.encode()).hexdigest()
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(row):
    return H("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def proofs_of(nodes):
    """Root of a list of nodes, and the siblings of each, with its place in the run."""
    proofs, spot, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for p, k in zip(proofs, spot):
            run, place = level[k - k % 3 : k - k % 3 + 3], k % 3
            p.append((place, "".join(run[:place] + run[place + 1 :])))
        spot = [k // 3 for k in spot]
        level = [H("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], proofs


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    out, roots = [], []
    for s in sources:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        root, proofs = proofs_of([leaf_of(r) for r in own])
        roots.append((root, own, proofs))
    top, above = proofs_of([r for r, _, _ in roots])
    for (root, own, proofs), more in zip(roots, above):
        for r, p in zip(own, proofs):
            proof = p + more
            shown = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                shown["text"] = r["text"].replace("\n", "")
            digest = leaf_of(shown)
            for place, siblings in proof:
                digest = H(siblings[: 64 * place] + digest + siblings[64 * place :])
            out.append((r["doc_id"], leaf_of(r), root, top, H("".join(x for _, x in proof)), digest, digest == top))
    return Counter(out)


@pytest.fixture(scope="module")
def table():
    chance = random.Random(3)
    rows = [{"doc_id": k, "source": chance.choice(["a", "a", "a", "b", "é", "Z", "", None]), "lang": chance.choice(["en", None]),
             "n_chars": chance.choice([None, 5, -1]), "text": chance.choice([None, "", "x\ny", "zwölf\n\n", "q" * 5000, f"t{k}"])} for k in range(400)]
    rows += [dict(rows[5]) for _ in range(4)] + [{"doc_id": None, "source": "a", "lang": None, "n_chars": None, "text": t} for t in (None, "x\ny", "x\ny")]
    return rows + [{"doc_id": 7, "source": f"only{k}", "lang": "", "n_chars": 0, "text": "a\nb"} for k in range(5)]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in FIELDS) + ("clash",) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string")


@pytest.mark.parametrize("n", [1, 3, 412])
def test_manifest(spark, table, tmp_path, n):
    rows = table[-n:]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_merkle_manifest(spark, str(tmp_path)).collect()
    want = brute_manifest(rows)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == want


@pytest.mark.parametrize("fan_in, stride", [(3, 1), (2, 3)])
def test_manifest_of_other_shapes(spark, table, fan_in, stride):
    docs = frame(spark, table)
    manifest = build_manifest(docs, leaf_digest(*[F.col(c) for c in FIELDS]), fan_in=fan_in, stride=stride)
    root = manifest.root().first().root
    every = manifest.proofs(carry=("doc_id",)).withColumn("end", folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(every) == len(table) and {r.end for r in every} == {root}
    some = manifest.proofs(F.col("doc_id") % 50 == 0, carry=("doc_id",)).collect()
    key = lambda rows: Counter((r.doc_id, r.leaf, tuple((p.place, p.siblings) for p in r.proof)) for r in rows)
    assert key(some) == key([r for r in every if r.doc_id is not None and r.doc_id % 50 == 0])


def test_manifest_of_nothing(spark, table):
    manifest = build_manifest(frame(spark, table).limit(0), leaf_digest(F.col("text")))
    assert manifest.root().collect() == [] and manifest.proofs(carry=("doc_id",)).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def brute_search(docs, items, k=10):
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_all, l_all = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = Counter()
    for item, text in set(items):
        scores = []
        for d, b, n in bags:
            m = 25 + 75 * n * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 8 * m)) for w in words(text) if w in b)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        for rank, (s, some, d) in enumerate(sorted(scores)[:k]):
            out[item, rank + 1, d if some else None, -s] += 1
    return out


@pytest.fixture(scope="module")
def corpus():
    chance = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "The", "ÄÖ", "äö", "x1", "İ", "naïve"]
    text = lambda n: chance.choice([" ", ".", "-", "\n"]).join(chance.choice(vocabulary[: chance.choice([6, 30, 67])]) for _ in range(n))
    docs = [(k, text(chance.randrange(0, 40))) for k in range(300)]
    docs += [(k, docs[4][1]) for k in (900, 901, 902)] + [docs[4]] * 3 + [(None, docs[4][1]), (None, "w1 w2"), (950, None), (951, ""), (952, "?! \n"), (953, "w3 " * 30000)]
    items = [(k, text(chance.randrange(1, 25))) for k in range(25)] + [(3, "the the THE w5"), (40, None), (41, ""), (42, "unknown words"), (43, docs[4][1]), (None, "w7 äö"), (44, "w3 w3 w9"), (44, "w3 w3 w9")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, corpus, monkeypatch, small):
    if small:
        for name, value in {"SEGMENT_BYTES": 800, "SHARD_WORDS": 400, "SEED_SHARDS": 4, "SHORT_POSTINGS": 12, "RANGE": 4, "QUERY_BLOCK_BYTES": 900}.items():
            monkeypatch.setattr(lexical_search, name, value)
    docs, items = corpus
    given = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, term string, rank int").repartition(3)
    index = lexical_search.build_index(given)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(index, asked).collect())
    want = brute_search(docs, items)
    assert got == want
    assert lexical_search.search(index, asked.limit(0)).collect() == []


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    for d in (docs, docs.limit(0)):
        assert lexical_search.search(lexical_search.build_index(d), items).collect() == []


def test_skipping_is_exact():
    """Ranges and candidates are skipped, and the best of a shard stay what they are, ties included."""
    chance = np.random.default_rng(5)
    shard = object.__new__(lexical_search._Shard)
    n = 5000
    shard.ids = chance.permutation(n).tolist()
    shard.edges = np.arange(0, n + lexical_search.RANGE, lexical_search.RANGE)
    lists = {f"t{k}": np.sort(chance.choice(n, size, replace=False)) for k, size in enumerate((3, 40, 700, 1500, 2500, 4900))}
    shard.lists = {t: shard.listed(at, chance.integers(1, 6, len(at))) for t, at in lists.items()}
    weights = {"t0": 9, "t1": 7, "t2": 5, "t3": 3, "t4": 2, "t5": 1, "absent": 4}
    score = np.zeros(n, np.int64)
    for t, (at, value, _, _) in shard.lists.items():
        score[at] += value * weights[t]
    want = sorted(zip((-score).tolist(), shard.ids, range(n)))[:10]
    assert shard.best(weights, 10, 0) == [(-s, p) for s, _, p in want]
    assert shard.best(weights, 10, -want[-1][0]) == [(-s, p) for s, _, p in want]


def brute_field(emission, stay):
    """Total, chances of good and expected repeats of one chain, over all ways to label it."""
    n, total, good, both = len(emission), 0.0, np.zeros(len(emission)), np.zeros(2)
    for way in product((0, 1), repeat=n):
        s = sum(e for e, y in zip(emission, way) if y) + sum(stay[a] for a, b in zip(way, way[1:]) if a == b)
        p = math.exp(s)
        total += p
        good += p * np.array(way)
        both += p * np.array([sum(a == b == k for a, b in zip(way, way[1:])) for k in (0, 1)])
    return math.log(total), good / total, both / total


def test_forward_backward():
    chance = np.random.default_rng(2)
    counts = np.array([3, 0, 1, 7, 2, 7, 0])
    emission, stay = chance.normal(0, 2, counts.sum()), np.array([0.8, -0.4])
    chains = crf.Chains(counts)
    total, good, both = chains.sums(emission, stay)
    want = [brute_field(emission[f : f + n], stay) for f, n in zip(np.cumsum(counts) - counts, counts) if n]
    assert np.allclose(good, np.concatenate([w[1] for w in want])) and np.allclose(sorted(total), sorted(w[0] for w in want))
    assert np.allclose(both, sum(w[2] for w in want))


def test_gradient():
    chance = np.random.default_rng(4)
    counts, labels = np.array([2, 0, 5, 1]), np.array([1, 0, 0, 1])
    features = chance.random((8, crf.FEATURES)) < 0.3
    weights = chance.normal(0, 0.3, crf.WEIGHTS)
    _, slope = crf.loss_and_gradient(counts, features.astype(float), labels, weights)
    for k in (0, 3, crf.FEATURES - 1, crf.FEATURES, crf.FEATURES + 1):
        step = np.zeros(crf.WEIGHTS)
        step[k] = 1e-5
        up, down = (crf.loss_and_gradient(counts, features.astype(float), labels, weights + s)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - slope[k]) < 1e-4


def test_neighbours_do_not_cross_texts():
    alone = crf.Lines([b"A plain line here.\nBUY!! NOW!!"]).features()
    beside = crf.Lines([b"x", b"", b"A plain line here.\nBUY!! NOW!!", b"\n \n", b"y z"]).features()
    assert (beside[1:3] == alone).all() and len(beside) == 4


def test_quality_held_out(spark):
    chance = random.Random(9)
    word = lambda: "".join(chance.choice("abcdefghilmnoprstu") for _ in range(chance.randrange(2, 9)))
    good = lambda: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(chance.randrange(1, 8)))
    bad = lambda: "\n".join(chance.choice([" | ".join(word() for _ in range(6)), " ".join(word().upper() + "!!" for _ in range(9)), " ".join([word()] * 15)]) for _ in range(chance.randrange(1, 8)))
    rows = [(k, bad() if k % 4 == 0 else good(), int(k % 4 != 0)) for k in range(400)]
    odd = [(1000, None, 1), (1001, "", 0), (1002, " \n", None), (1003, good() * 300, 1), (1004, bad(), None), (None, good(), None), (1005, "one", 1), (1005, "one", 1)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + odd], "doc_id long, text string, label int, counts string")
    model = crf.learn_quality(docs.filter(~crf.held_out(F.col("doc_id"))))
    got = crf.score_quality(docs, model).collect()
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 and len(r.line_good) == r.n_lines for r in got)
    label = {d: y for d, _, y in rows if zlib.crc32(str(d).encode()) % 3 == 1}
    hits = [(r.score >= 0.5) == bool(label[r.doc_id]) for r in got if r.doc_id in label]
    assert len(hits) > 100 and sum(hits) >= 0.95 * len(hits)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r.score)
    assert by_id[1000] == by_id[1001] == by_id[1002] and len(set(by_id[1005])) == 1 and by_id[1003][0] > 0.5
    assert crf.score_quality(docs.limit(0), model).collect() == []
    nothing = crf.learn_quality(docs.limit(0))
    assert all(abs(r.score - 0.5) < 1e-6 for r in crf.score_quality(docs, nothing).collect())


def test_mixed_lines_are_told_apart(spark):
    """A bad run of lines inside a good text lowers it, by its length."""
    good, bad = "Some plain words stand in this line.", "BUY!! NOW!! FREE!! BUY!! NOW!! FREE!!"
    rows = [(k, "\n".join([good if k % 2 else bad] * 6), k % 2) for k in range(60)]
    model = crf.learn_quality(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    mixed = spark.createDataFrame([(1, "\n".join([good] * 8)), (2, "\n".join([good] * 4 + [bad] * 4)), (3, "\n".join([bad] * 8))], "doc_id long, text string")
    raw = {r.doc_id: r.raw for r in crf.score_quality(mixed, model).collect()}
    assert raw[1] >= raw[2] >= raw[3] and raw[1] > raw[3]
