"""License scans: templates with optional and replaceable regions, matched as token automata.

A template is a line of words; `[words]` may be missing, `{n}` stands for up to n words of any kind.
It accepts a stretch of a text if all mandatory words stand there, in order, with nothing else between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.hashing import ASCII_LOWER, LETTERS_DIGITS

# The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Templates by label, in lower-case words.
TEMPLATES = {
    "mit": [
        "under [the terms of] the mit [open source] license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction",
    ],
    "apache-2": ["licensed under the apache [software] license [version] 2 [0]", "apache license version 2 [0]"],
    "cc-by-nc": ["under [a] [the] [creative commons] cc by nc {1} 0", "creative commons attribution noncommercial {1} 0 [international] license"],
    "cc-by": ["under [a] [the] creative commons attribution {1} 0 [international] license"],
    "gpl-3": ["under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3"],
    "gpl-2": ["under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2"],
    "lgpl-3": ["under the [terms of the] gnu lesser general public license [as published by the free software foundation] [either] version 3"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2": ["subject to the terms of the mozilla public license v 2 0"],
    "proprietary": ["[copyright] {6} all rights reserved"],
}
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "labels array<string>, score double, spans array<struct<label:string,start:long,end:long>>")


def compile_template(template: str) -> tuple:
    """States of an automaton: ("word", w), ("skip", n) for up to n free words, ("jump", k) to leave out the next k states."""
    states, opened = [], None
    for token in template.replace("[", " [ ").replace("]", " ] ").replace("{", " {").split():
        if token == "[":
            opened = len(states)
            states.append(None)
        elif token == "]":
            states[opened] = ("jump", len(states) - opened - 1)
        elif token.startswith("{"):
            states.append(("skip", int(token[1:-1])))
        else:
            states.append(("word", token.encode()))
    return tuple(states)


def _closure(states: tuple, at: set) -> set:
    """Positions (state, free words used) reachable without reading a word."""
    todo, out = list(at), set()
    while todo:
        place = todo.pop()
        if place in out:
            continue
        out.add(place)
        k = place[0]
        if k < len(states) and states[k][0] == "jump":
            todo += [(k + 1, 0), (k + 1 + states[k][1], 0)]
        elif k < len(states) and states[k][0] == "skip":
            todo.append((k + 1, 0))
    return out


def longest_match(states: tuple, words: list[bytes], start: int) -> int | None:
    """End of the longest stretch from `start` that the automaton accepts."""
    at, end, k = _closure(states, {(0, 0)}), None, start
    while at:
        if any(s == len(states) for s, _ in at):
            end = k
        if k == len(words):
            break
        step = set()
        for s, used in at:
            if s == len(states):
                continue
            kind, value = states[s]
            if kind == "word" and value == words[k]:
                step.add((s + 1, 0))
            elif kind == "skip" and used < value:
                step.add((s, used + 1))
        at, k = _closure(states, step), k + 1
    return end


def _anchor(states: tuple) -> bytes:
    """The longest mandatory run of words: a text without it cannot match."""
    best, run, hidden = [], [], 0
    for kind, value in states:
        if kind == "word" and not hidden:
            run.append(value)
            best = max(best, run, key=lambda r: sum(map(len, r)))
        else:
            run = []
        hidden = value if kind == "jump" else max(0, hidden - 1)
    return b" " + b" ".join(best) + b" "


class _Scanner:
    def __init__(self, phrases: dict, templates: dict):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.templates = [(_anchor(s), s, label) for label, many in templates.items() for s in map(compile_template, many)]
        self.longest = max((sum(v if k == "skip" else 1 for k, v in s) for _, s, _ in self.templates), default=0)
        self.plain = np.where(LETTERS_DIGITS[ASCII_LOWER], ASCII_LOWER, 32).astype(np.uint8).tobytes()

    @staticmethod
    def _found(text: bytes, part: bytes) -> Iterator[int]:
        """Word positions at which `part` stands."""
        at, word, before = text.find(part), 0, 0
        while at >= 0:
            word += text.count(b" ", before, at)
            before = at
            yield word
            at = text.find(part, at + 1)

    def scan(self, text: bytes) -> tuple:
        words = text.translate(self.plain).split()
        line = b" " + b" ".join(words) + b" "
        base = [(at, label) for phrase, label in self.phrases for at in self._found(line, phrase)]
        spans = set()
        for anchor, states, label in self.templates:
            if anchor not in line:
                continue
            starts = {s for at in self._found(line, anchor) for s in range(max(0, at - self.longest), at + 1)}
            ends = ((label, s, longest_match(states, words, s)) for s in sorted(starts))
            best: dict = {}
            for _, s, e in ends:
                if e is not None and (e not in best or s < best[e]):
                    best[e] = s
            spans |= {(label, s, e) for e, s in best.items()}
        places = [at for at, _ in base]
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(label for label, _, _ in spans)})
        return len(words), len(base), min(places, default=None), max(places, default=None), base_labels, labels, 1.0 if spans else 0.5 if base else 0.0, sorted(spans)


def scan_licenses(docs: DataFrame, phrases: dict = PHRASES, templates: dict = TEMPLATES) -> DataFrame:
    """Base phrases and license templates found in each document.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. `spans` are word ranges that a template accepts,
    of those with one end the longest. score: 1 if a template accepts, 0.5 if only a base phrase stands, else 0.
    Null and blank texts have no words and no labels; rows are judged one by one, so equal rows
    get equal results; an empty table gives an empty table; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(phrases, templates)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
        kinds.append(pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            found = [scanner.scan(t or b"") for t in batch["text"].cast(pa.large_binary()).to_pylist()]
            columns = [list(c) for c in zip(*found)] or [[] for _ in names]
            columns[-1] = [[dict(zip(("label", "start", "end"), s)) for s in spans] for spans in columns[-1]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")})


QUERIES = {"op7_license_scan": (op7_license_scan, None)}
