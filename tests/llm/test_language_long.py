"""Texts with more distinct trigrams than the space of vectors holds."""

import random

import numpy as np

from corpusweave.llm.language_id import _Space, _grams, learn_profiles, predict_language


def test_text_with_many_trigrams(spark):
    chance = random.Random(3)
    letters = [chr(c) for c in range(0x400, 0x600) if chr(c).isalpha()] + list("abcdefghijklmnopqrstuvwxyz")
    text = "".join(chance.choice(letters) for _ in range(200_000))
    grams, times = _grams(text)
    assert len(grams) > 2 * _Space.MOST - 20_000
    space = _Space(32, 7)
    a, b, c = grams // 4096, grams // 64 % 64, grams % 64
    want = times @ (space.first[a] * space.second[b] * space.third[c])
    for _ in range(2):
        assert np.array_equal(space.bundle(grams, times), want)
        assert np.array_equal(space.bundle(grams[:9], times[:9]), times[:9] @ (space.first[a[:9]] * space.second[b[:9]] * space.third[c[:9]]))
    docs = spark.createDataFrame([(1, text, "mix"), (2, "the cat and the dog", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in predict_language(docs, learn_profiles(docs)).collect()}
    assert got == {1: "mix", 2: "en"}
