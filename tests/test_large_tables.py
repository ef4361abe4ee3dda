"""What keeps the queries within bounds on large tables: no broadcast of texts, no work that grows with a group's square."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from corpusweave.operators.clones import _windows, clone_groups, clone_windows
from corpusweave.operators.edits import dedupe_edits
from corpusweave.operators.rewrite import bulk_rename, rewrite_string_paths


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grown_from_small_files(spark, folder, rows=300):
    """A table of texts whose files are far smaller than the texts made from them."""
    spark.range(1, rows + 1).write.mode("overwrite").parquet(folder)
    keys = spark.read.parquet(folder)
    return keys.select(F.concat(F.lit("c"), "id").alias("path"), F.concat(F.lit("calc"), "id", F.lit("(data/part1)")).alias("content"))


def test_bulk_rename_broadcasts_neither_texts_nor_renames(spark, tmp_path):
    files = grown_from_small_files(spark, str(tmp_path / "part"))
    renames = files.select(F.regexp_extract("content", r"^\w+", 0).alias("old"), F.concat(F.lit("compute_"), "path").alias("new"))
    done = bulk_rename(files, renames)
    assert "BroadcastExchange" not in plan_of(done)
    assert done.filter(F.col("new_content") == F.concat(F.lit("compute_"), "path", F.lit("(data/part1)"))).filter("renamed = 1").count() == 300


def folded_plainly(starts, ends, weights):
    def meet(a, b):
        return None not in (starts[a], ends[a], starts[b], ends[b]) and starts[a] < ends[b] and starts[b] < ends[a]

    kept = []
    for i in range(len(starts)):
        met = next((j for j, k in enumerate(kept) if meet(k, i)), None)
        if met is None:
            kept.append(i)
        elif None not in (weights[i], weights[kept[met]]) and weights[i] > weights[kept[met]]:
            kept[met] = i
    return kept


def test_survivors_equal_the_plain_fold():
    from corpusweave.operators.edits import _survivors

    draw = random.Random(5)
    column = pa.list_(pa.int64())
    for _ in range(500):
        n, far, odd = draw.randint(1, 40), draw.choice([6, 20, 100]), draw.random() < 0.4
        starts = [None if odd and draw.random() < 0.1 else draw.randint(-2, far) for _ in range(n)]
        ends = [None if odd and draw.random() < 0.1 else (s or 0) + draw.randint(-3 if odd else 0, draw.choice([2, 8, 30])) for s in starts]
        weights = [None if odd and draw.random() < 0.1 else draw.randint(0, 6) for _ in range(n)]
        got = _survivors(*[pa.array([c], column) for c in (starts, ends, weights)]).to_pylist()
        assert got == [folded_plainly(starts, ends, weights)]


def test_many_connected_edits_of_a_file_are_folded_in_time(spark):
    # Each edit overlaps its two neighbours; every other one stays. Even ones come first.
    n = 60_000
    i = F.col("id")
    edits = spark.range(n).select(
        F.lit("a").alias("path"), F.when(i % 2 == 0, i).otherwise(i + n).alias("edit_no"), (i * 10).alias("start_off"),
        (i * 10 + 11).alias("end_off"), F.lit("old").alias("original_text"), F.concat(F.lit("n"), i).alias("new_text"))
    begun = time.monotonic()
    kept = dedupe_edits(edits).agg(F.count("*"), F.max(F.col("start_off") % 20)).first()
    assert tuple(kept) == (n // 2, 0)
    assert time.monotonic() - begun < 60


def test_only_windows_that_may_repeat_are_hashed(spark):
    draw = random.Random(3)
    text = lambda n, letters: " ".join(draw.choice(letters) + str(draw.randrange(len(letters))) for _ in range(n))
    shared = text(30, "abcdefghij")
    files = [(f"f{i}", text(200, "klmnopqrstuvwxyz") + f" {i} " + (shared if i % 40 == 0 else "")) for i in range(80)]
    # Few words, so that most windows repeat; null, empty and short texts, one path twice, no path.
    files += [(f"g{i}", text(draw.randrange(40), "ab")) for i in range(30)]
    files += [("n", None), ("e", ""), ("s", "one two"), ("f0", shared + " tail"), (None, shared)]
    table = spark.createDataFrame(files, "path string, content string")
    for size in (1, 2, 7, 12):
        places = {}
        for path, content in files:
            words = (content or "").split()
            for at in range(len(words) - size + 1):
                places.setdefault(tuple(words[at : at + size]), []).append((path or "", at))
        want = sorted((len(p), min(p)) for p in places.values() if len(p) > 1)
        got = clone_windows(table, size).select("places", "first.*").collect()
        assert sorted((r[0], (r[1] or "", r[2])) for r in got) == want
    total = sum(max(0, len((c or "").split()) - 11) for _, c in files)
    assert _windows(table.filter("path like 'f%'"), 12).count() < total / 5
    lone = [("a", "x " + shared + " y"), ("b", shared)]
    runs = clone_groups(spark.createDataFrame(lone, "path string, content string"), 12).collect()
    assert sorted(tuple(r) for r in runs) == [("a", 1, 30, 2), ("b", 0, 30, 2)]


def test_path_keys_of_texts_are_not_gathered(spark, tmp_path):
    files = grown_from_small_files(spark, str(tmp_path / "part")).withColumn("content", F.concat(F.lit("x = 'data/part1/"), "path", F.lit("'")))
    renames = spark.createDataFrame([("data/part1", "data/component1")], "old string, new string")
    done = rewrite_string_paths(files, renames)
    plan = plan_of(done)
    # Keys of all texts are neither made distinct nor dealt by a shuffle; texts are not broadcast.
    texts = [line for line in plan.splitlines() if "_key" in line and "old#" not in line]
    assert not [line for line in texts if ("Exchange hash" in line or "Aggregate(keys=[path" in line)]
    assert plan.count("BroadcastExchange") <= 1
    assert done.filter(F.col("new_content") == F.concat(F.lit("x = 'data/component1/"), "path", F.lit("'"))).count() == 300


def test_edits_are_applied_to_a_few_texts_at_a_time():
    import tracemalloc

    from corpusweave.operators.edits import _apply

    n, text = 2_000, "word\n" * 4_000
    edit = {"start_off": 0, "edit_no": 7, "end_off": 5, "original_text": "word\n", "new_text": "w"}
    texts, edits = pa.array([text] * n), pa.array([[edit, {**edit, "start_off": 1, "edit_no": 8}]] * n)
    tracemalloc.start()
    done = _apply(texts, edits)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < n * len(text) / 4
    assert done[n - 1].as_py()["new_content"] == "w" + text[5:]
    assert [tuple(e.values()) for e in done[0].as_py()["edits"]] == [(7, None, 1, 2, 1, 5), (8, "overlaps previous", 0, 0, 0, 0)]


def test_symbol_occurrences_cut_lines_by_one_pattern(spark):
    from corpusweave.operators.search import LINE_TOKEN, symbol_occurrences

    lines = ['a "b a" a', "a 'a", 'x "a\\', "é_1 a`a`a", '"a\\"a" a', "", "  ", "a", "'", '"a" + \'a\'a']
    table = spark.createDataFrame([("p", "\n".join(lines)), ("n", None)], "path string, content string")
    found = symbol_occurrences(table, spark.createDataFrame([("a",), ("é_1",)], "name string")).collect()
    want = [(0, 0), (0, 8), (1, 0), (2, 3), (3, 4), (3, 8), (4, 7), (7, 0), (9, 9)]
    assert sorted((r["line"], r["col"]) for r in found if r["name"] == "a") == want
    assert [(r["line"], r["col"]) for r in found if r["name"] == "é_1"] == [(3, 0)]
    whole = spark.createDataFrame([(x,) for x in lines], "t string").select("t", F.array_join(F.regexp_extract_all("t", F.lit(LINE_TOKEN), F.lit(0)), ""))
    assert all(a == b for a, b in whole.collect())
