"""Stages of the pipeline against expected rows, with null and equal ids."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from corpus_pipeline import STAGES, benchmark, language, lines, near_copies, run  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], SCHEMA)


def prose(chance, n):
    return " ".join("".join(chance.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_near_copies_with_null_and_equal_ids(spark):
    chance = random.Random(4)
    a, b, c, d, e, f, g = (prose(chance, 60) for _ in range(7))
    rows = [(None, a), (None, b), (None, c), (7, d), (7, e), (8, f), (3, f + " more"), (None, f + " and more"), (None, g), (None, g + " x")]
    got = sorted(((r.doc_id, r.text) for r in near_copies(spark, table(spark, rows), "").collect()), key=str)
    assert (3, f + " more") in got and sum(t.startswith(g) for _, t in got) == 1
    assert sorted(((i, t) for i, t in got if not t.startswith(g)), key=str) == sorted([(None, a), (None, b), (None, c), (7, d), (7, e), (3, f + " more")], key=str)


def test_stages_and_run_keep_distinct_documents(spark, tmp_path):
    chance = random.Random(6)
    clean = [prose(chance, 40) for _ in range(6)]
    rows = list(zip([None, None, None, 5, 5, 9], clean))
    docs = table(spark, [*rows, (11, "12 !?"), (12, clean[5])])
    assert sorted(r.text for r in language(spark, docs, "").collect()) == sorted([*clean, clean[5]])
    assert sorted(r.text for r in lines(spark, docs, "").collect()) == sorted([*clean, "12 !?"])
    item = prose(chance, 20)
    leaking = table(spark, [*rows, (None, item + " " + prose(chance, 9)), (5, prose(chance, 9) + " " + item), (13, " ".join(item.split()[:9]))])
    leaking.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in STAGES] == ["language", "lines", "near_copies", "benchmark", "packing"]
    assert sorted(r.text for r in benchmark(spark, leaking, str(tmp_path)).collect()) == sorted([*clean, " ".join(item.split()[:9])])
    packed = run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.piece) for r in packed), key=str) == sorted([(d, 0) for d, _ in rows] + [(13, 0)], key=str)
