"""Every operator on null, empty, repeated and long texts, clashing columns and empty tables, by brute force where there is one."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusweave.llm.chat_format import link_tool_calls
from corpusweave.llm.decontamination import decontaminate
from corpusweave.llm.language_id import learn_profiles, predict_language
from corpusweave.llm.license_scan import compile_template, longest_match, scan_licenses
from corpusweave.llm.line_dedup import dedup_lines, edit_distance, similar
from corpusweave.llm.packing import PieceEncoder, best_fit, pack, token_pieces
from corpusweave.llm.quality import clean_lines
from corpusweave.llm.substring_dedup import substring_dedup
from corpusweave.llm.suffix_dedup import suffix_dedup

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    chance = random.Random(5)
    words = ["alpha", "Beta", "gämma", "delta.", "eps#", "zeta\n", "eta", "12"]
    text = lambda n: " ".join(chance.choice(words) + str(chance.randrange(40)) for _ in range(n))
    passage = text(60)
    rows = [(k, text(chance.randrange(0, 90))) for k in range(30)]
    rows += [(40 + k, text(20) + " " + passage + " " + text(15)) for k in range(4)]
    rows += [(50, passage), (51, passage), (52, None), (53, ""), (54, " \n\t"), (55, "x " * 9000), (56, "only one"), (56, "only one"), (57, None)]
    # Columns that operators use for themselves.
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as row_key", "'g' as group", "1 as length", "2 as n_words")


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def repeated(units, size):
    """Mask per document of units inside windows that start at two places or more."""
    seen = Counter(tuple(u[i : i + size]) for u in units for i in range(len(u) - size + 1))
    masks = []
    for u in units:
        mask = [False] * len(u)
        for i in range(len(u) - size + 1):
            if seen[tuple(u[i : i + size])] > 1:
                mask[i : i + size] = [True] * size
        masks.append(mask)
    return masks


def test_substring_dedup(docs):
    rows = texts(docs)
    units = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in rows]
    want = Counter((d, len(u), sum(m), " ".join(w for w, gone in zip(u, m) if not gone)) for (d, _), u, m in zip(rows, units, repeated(units, 35)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs).collect()) == want
    assert substring_dedup(docs.limit(0)).collect() == []


def test_suffix_dedup(docs):
    rows = texts(docs)
    units = [t.encode() for _, t in rows]
    want = Counter((d, len(u), sum(m), bytes(b for b, gone in zip(u, m) if not gone)) for (d, _), u, m in zip(rows, units, repeated(units, 400)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept_bytes)) for r in suffix_dedup(docs).collect()) == want
    assert suffix_dedup(docs.limit(0)).collect() == []


def test_language(spark):
    english = ["the cat and the dog were there with that other thing", "this is what they thought of the weather"]
    german = ["der hund und die katze waren nicht mit dem anderen ding da", "das ist was sie sich gedacht haben auf dem weg"]
    learn = spark.createDataFrame([(t, "en") for t in english] + [(t, "de") for t in german] + [(None, "xx"), ("x", None)], "text string, lang string")
    profiles = learn_profiles(learn)
    assert list(profiles) == ["de", "en"]
    ask = spark.createDataFrame([(1, "that was the other dog"), (2, "und das ist der weg"), (3, None), (4, ""), (5, "12 !?"), (None, "the thing")], "doc_id long, text string")
    got = {r.doc_id: r for r in predict_language(ask, profiles).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, None)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[3].score == 0
    assert {r.lang_pred for r in predict_language(ask, {}).collect()} == {"und"}
    assert learn_profiles(learn.limit(0)) == {} and predict_language(ask.limit(0), profiles).collect() == []


def test_line_dedup(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, f"{base}\nunique here\n\n---"), (2, f"{base.upper()}\nother line\n---"), (3, f"{base}!\nnumber 17"), (4, "number 42\n"), (5, None), (6, "")]
    got = {r.doc_id: r.kept_text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line_no")).collect()}
    assert got == {1: f"{base}\nunique here\n\n---", 2: "other line\n---", 3: "number 17", 4: "", 5: "", 6: ""}
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    chance = random.Random(2)
    for _ in range(200):
        a, b = ("".join(chance.choice("abc") for _ in range(chance.randrange(9))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if not b else _next_row(row, i, x, b)
        assert edit_distance(a, b) == row[-1]
    assert similar("abcd", "abce", 75) and not similar("abcd", "abef", 75)


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_quality(docs):
    got = defaultdict(list)
    for r in clean_lines(docs).collect():
        got[r.doc_id].append(r)
    for d, t in texts(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        repeats = sum(repeated([w], 8)[0])
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats, len(w) < 20 or 100 * repeats > 30 * len(w))
        assert tuple(got[d][0])[1:7] == want
    assert clean_lines(docs.limit(0)).collect() == []


def test_quality_rules(spark):
    prose = "This is a plain sentence of a clean page, with some words in it.\n" * 1 + "And here another one follows that says something more."
    menu = "Home | News | Sport | Contact | About\n" * 8
    rows = [(1, prose), (2, prose + "\nAll rights reserved."), (3, menu + prose), (4, "ab### cd$$$ ef%%% " * 12)]
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].kept for k in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[2].clean_text == prose and got[3].n_lines_failed == 8


def test_license_templates(spark):
    states = compile_template("under [the terms of] the mit license {2} end")
    assert longest_match(states, b"under the mit license a b end".split(), 0) == 7
    assert longest_match(states, b"under the terms of the mit license end x".split(), 0) == 8
    assert longest_match(states, b"under the mit license a b c end".split(), 0) is None
    rows = [(1, "Released UNDER the MIT license. under the mit license"), (2, "Licensed under the Apache License, Version 2.0."), (3, None), (4, ""),
            (5, "under the GNU General Public License, version 3"), (6, "no license at all"), (7, "x " * 20000 + "CC-BY-NC")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as labels")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 5, ["mit"])
    assert (got[2].base_labels, got[2].score, got[5].labels, got[6].labels, got[3].n_words) == (["apache-2"], 1.0, ["gpl-3"], [], 0)
    assert (got[7].n_base, got[7].first_word, got[7].score) == (1, 20000, 0.5)


def test_decontamination(spark, docs):
    passage = next(t for d, t in texts(docs) if d == 50)
    items = spark.createDataFrame([(1, passage[:200]), (1, passage[:200]), (2, "Only ONE"), (3, None), (4, "!!"), (5, "never anywhere in there")], "item_id long, text string")
    clean = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    windows = defaultdict(set)
    for r in items.collect():
        w = clean.findall(lower(r.text or ""))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(r.item_id))
    want = Counter()
    for d, t in texts(docs):
        w, hit, met = clean.findall(lower(t)), set(), set()
        for window, ids in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    met |= ids
        want[d, len(w), len(hit), ",".join(sorted(met))] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)) for r in decontaminate(docs, items).collect())
    assert set(got) == set(want)
    assert all(r.n_hit == 0 for r in decontaminate(docs, items.limit(0)).collect()) and decontaminate(docs.limit(0), items).collect() == []


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "add", '{"y": 2, "x": 1.5}', []), (1, "b", 1, "add", '{"x": "1"}', ["a", "gone"]), (1, "c", 2, "nope", "{", ["b", "a"]),
         (1, "d", 3, "add", "[1]", ["e"]), (1, "e", 4, "add", None, ["d"]), (1, None, 5, "add", '{"x":1,"y":2,"z":{"b":1,"a":[1]}}', None)],
        "conv_id long, call_id string, seq long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", "three\n"), (1, "zz", None), (1, "c", "x"), (1, "c", "y")], "conv_id long, call_id string, content string")
    schemas = spark.createDataFrame([("add", "x", "number", True, None, None), ("add", "y", "integer", True, 0.0, 9.0)],
                                    "name string, field string, type string, required boolean, least double, most double")
    got = defaultdict(list)
    for r in link_tool_calls(calls, results, schemas).collect():
        got[r.call_id].append(r)
    assert [(r.status, r.level, r.errors) for r in got["a"] + got["b"]] == [("answered", 0, []), ("unanswered", 1, ["missing:y", "type:x"])]
    assert got["a"][0].message == '{"arguments":{"x":1.5,"y":2},"content":"three\\n","id":"a","level":0,"name":"add","status":"answered"}'
    assert [(r.status, r.level, r.errors) for r in got["c"]] == [("repeated", 2, ["unknown_tool"])] * 2
    assert {got[k][0].status for k in "de"} == {"cycle"} and got["zz"][0].status == "orphan"
    assert got[None][0].errors == ["unknown:z"] and '{"x":1,"y":2,"z":{"a":[1],"b":1}}' in got[None][0].message
    assert link_tool_calls(calls.limit(0), results.limit(0), schemas).collect() == []


def test_links_of_rows_full_of_nulls(spark):
    calls = spark.createDataFrame([(None, "a", None, None, None, None), (None, "b", None, None, None, None)], "conv_id string, call_id string, seq int, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(None, "a", None), (None, "o", None), (None, None, None)], "conv_id string, call_id string, content string")
    schemas = spark.createDataFrame([], "name string, field string, type string, required boolean, least double, most double")
    got = {(r.call_id, r.status, tuple(r.errors)) for r in link_tool_calls(calls, results, schemas).collect()}
    assert got == {("a", "answered", ("unknown_tool",)), ("b", "unanswered", ("unknown_tool",)), ("o", "orphan", ()), (None, "orphan", ())}


def test_packing(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    encoder = PieceEncoder(TOKENIZER)
    odd = ["", " ", "  two  spaces ", "a\n\nb", "tab\t x", "it's <|endoftext|> ok", "Über straße  x", "日本語 テキスト", "a \nb", "\x1c x", "don't we'll 12a"]
    for text in odd + [t for _, t in texts(docs)]:
        assert np.frombuffer(encoder.encoded(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    got = pack(token_pieces(docs, TOKENIZER), group_items=16).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    ids = {d: np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u4") for d, t in texts(docs)}
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(d for d, _ in texts(docs))
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and (r.piece == 0 or r.length == 1024)
    assert pack(token_pieces(docs.limit(0), TOKENIZER)).collect() == []
    assert sorted(map(len, best_fit([0, 1, 2, 3], [6, 4, 5, 5], [], 10))) == [2, 2]
