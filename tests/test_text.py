"""Search and rewrite on small texts."""

import re

import pytest
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusweave.functions.casing import case_style, identifier_words, in_style
from corpusweave.functions.text import glob_regex, lines_of, running_max, running_sum
from corpusweave.operators import rewrite as rw
from corpusweave.operators import search as se
from corpusweave.operators.edits import apply_edits, edit_reports, edit_statistics
from corpusweave.sources.corpus import apply_scope, as_files, read_corpus, text_gate, write_rewritten

QUIET = settings(derandomize=True, max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
TEXTS = st.lists(st.text(alphabet="ab _\n\réßA1", max_size=40), min_size=1, max_size=12)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def naive_hits(text, pattern):
    at, out = text.find(pattern), []
    while at >= 0:
        line = text.count("\n", 0, at)
        out.append((at, line, at - (text.rfind("\n", 0, at) + 1)))
        at = text.find(pattern, at + len(pattern))
    return out


@QUIET
@given(TEXTS, st.sampled_from(["a", "ab", "aa", "\n", "b\na", "é"]))
def test_literal_search_equals_a_scan(spark, texts, pattern):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    got = rows(se.literal_search(df, pattern), "path", "start_off", "line", "col")
    assert got == sorted((str(i), *h) for i, t in enumerate(texts) for h in naive_hits(t, pattern))


@QUIET
@given(TEXTS, st.sampled_from([("a", "<>"), ("ab", ""), ("b", "a\nb")]))
def test_applying_found_edits_equals_replace(spark, texts, pair):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    done = apply_edits(df, rw.find_replace(df, *pair))
    got = rows(done, "path", "new_content")
    assert got == sorted((str(i), t.replace(*pair)) for i, t in enumerate(texts) if pair[0] in t)


@QUIET
@example(["\n\na"])
@given(TEXTS)
def test_removed_plus_kept_are_all_lines(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    for r in rw.remove_lines(df, lambda line: line.contains("a")).collect():
        lines = re.split("\r?\n", re.sub("\r?\n\\Z", "", r.content)) if r.content else []
        kept = [line for line in lines if "a" not in line]
        assert r.removed == len(lines) - len(kept)
        joined = "\n".join(kept)
        assert r.new_content.replace("\r\n", "\n") in (joined, joined + "\n")


@QUIET
@given(st.lists(st.integers(-50, 50), max_size=60))
def test_running_arrays(spark, numbers):
    df = spark.createDataFrame([(numbers,)], "v array<bigint>")
    sums, tops = df.select(running_sum(F.col("v")), running_max(F.col("v"))).first()
    assert sums == [sum(numbers[: i + 1]) for i in range(len(numbers))]
    assert tops == [max([0, *numbers[: i + 1]]) for i in range(len(numbers))]


def test_whole_words(spark, files_of):
    df = files_of(("a", "user is not username"), ("b", "xuser user_ user"), ("c", "üuser useruser"))
    assert rows(se.literal_search(df, "user", whole_word=True), "path", "start_off") == [("a", 0), ("b", 12)]
    text = df.select("path", rw.replaced_text(F.col("content"), "user", "U", whole_word=True).alias("t"))
    assert rows(text, "path", "t") == [("a", "U is not username"), ("b", "xuser user_ U"), ("c", "üuser useruser")]


def test_overlapping_pattern_does_not_rescan(files_of):
    assert rows(se.literal_search(files_of(("a", "aaaa")), "aa"), "start_off") == [(0,), (2,)]


def test_regex_groups_and_template(files_of):
    df = files_of(("a", "get_user(1)\nget_team(22)"))
    edits = rw.find_replace(df, r"get_(?P<what_kind>\w+)\((\d+)\)", "load('${what_kind}', $2)$$", mode="regex")
    assert rows(edits, "start_line", "start_col", "original_text", "new_text") == [
        (0, 0, "get_user(1)", "load('user', 1)$"), (1, 0, "get_team(22)", "load('team', 22)$")]
    out = df.select(rw.replaced_text(F.col("content"), r"get_(?P<k>\w+)\((\d+)\)", "${k}$$1$2", mode="regex").alias("t"))
    assert out.first().t == "user$11\nteam$122"


def test_empty_regex_hits_keep_offsets(files_of):
    assert rows(se.regex_search(files_of(("a", "ab")), "x*"), "start_off", "end_off") == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("pattern,template", [("", "x"), ("(", "x"), ("a", "$1"), ("a", "${n}"), ("a", "${"), ("a", "$"), ("a", "$x")])
def test_bad_patterns_and_templates(files_of, pattern, template):
    with pytest.raises(ValueError):
        rw.find_replace(files_of(("a", "a")), pattern, template, mode="regex")


def test_case_styles(spark):
    want = {
        "user_name": "snake", "userName": "camel", "UserName": "pascal", "USER_NAME": "screaming",
        "XMLHttpRequest": "mixed", "user-name": "kebab", "user": "lower", "USER": "upper", "Username": "pascal",
        "x": "lower", "": "unknown", "getHTTPStatus": "mixed",
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.s for r in df.select("t", case_style(F.col("t")).alias("s")).collect()} == want


def test_restyling(spark):
    df = spark.createDataFrame([(s,) for s in ("snake", "camel", "pascal", "screaming", "kebab", "upper", "lower", "mixed")], "s string")
    got = {r.s: r.t for r in df.select("s", in_style(F.lit("account_id"), F.col("s")).alias("t")).collect()}
    assert got == {
        "snake": "account_id", "camel": "accountId", "pascal": "AccountId", "screaming": "ACCOUNT_ID",
        "kebab": "account-id", "upper": "ACCOUNTID", "lower": "accountid", "mixed": "AccountId"}
    words = spark.range(1).select(*[identifier_words(F.lit(t)).alias(t) for t in ("userName", "user2Name", "HTTPServer", "user-name")]).first()
    assert [list(w) for w in words] == [["user", "name"], ["user2", "name"], ["http", "server"], ["user", "name"]]


def test_preserve_case(files_of):
    df = files_of(("a", "user_name userName UserName USER_NAME"))
    edits = rw.find_replace(df, "(?i)user_?name", "account_id", mode="regex", preserve_case=True)
    assert [r.new_text for r in edits.orderBy("start_off").collect()] == ["account_id", "accountId", "AccountId", "ACCOUNT_ID"]


def test_symbols_in_quotes_do_not_count(spark, files_of):
    df = files_of(("a", "foo(bar) 'foo' \"x \\\" foo\" foo_ foo\n`foo\nbar"))
    names = spark.createDataFrame([("foo",), ("bar",)], "name string")
    assert rows(se.symbol_occurrences(df, names), "name", "line", "col") == [
        ("bar", 0, 4), ("bar", 2, 0), ("foo", 0, 0), ("foo", 0, 31)]


def test_literals_in_code_only(files_of):
    df = files_of(("a", "x = 42 // 42\ny = 42\nz = a42"), ("b", 'print("hi"); /* 42 */ s = "42"\nt = "hi"'))
    assert rows(se.literal_occurrences(df), "literal", "uses", "files") == [('"hi"', 2, 1), ("42", 2, 1)]


def test_bulk_rename_and_conflicts(spark, files_of):
    renames = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "old string, new string")
    out = rw.bulk_rename(files_of(("f", "a ab b.c"), ("g", "nothing")), renames)
    assert rows(out, "path", "new_content", "renamed") == [("f", "x ab x.y", 3)]
    assert rows(rw.rename_conflicts(renames), "new", "sources", "first_source") == [("x", 2, "a")]


def test_config_paths(spark, files_of):
    renames = spark.createDataFrame([("src/old", "src/new")], "old string, new string")
    out = rw.rewrite_config_paths(files_of(
        ("a.yml", "# src/old\nsrc/old: v\nk: src/old/a src/old/b\n- src/old\nk2: old\n"),
        (".gitignore", "src/old/x\n# src/old\n*.log"), ("b.yml", "k: other/path")), renames)
    assert rows(out, "path", "new_content", "changes") == [
        (".gitignore", "src/new/x\n# src/old\n*.log", 1),
        ("a.yml", "# src/old\nsrc/old: v\nk: src/new/a src/old/b\n- src/new\nk2: old\n", 2)]


def test_string_paths(spark, files_of):
    renames = spark.createDataFrame([("tests", "e2e"), ("lib", "lib/core")], "old string, new string")
    text = 'a = "tests/x.py"\nb = \'../tests/y\'\nc = r"tests/z"\nd = "mytests/x"\ne = f"tests/{n}"\nf = "lib/a"\ng = "lib/core/a"\nh = "tests"'
    out = rw.rewrite_string_paths(files_of(("m.py", text)), renames).first()
    assert out.new_content.split("\n") == [
        'a = "e2e/x.py"', "b = '../e2e/y'", 'c = r"tests/z"', 'd = "mytests/x"', 'e = f"tests/{n}"', 'f = "lib/core/a"',
        'g = "lib/core/a"', 'h = "tests"']


def test_edit_application_reports(spark, files_of):
    df = files_of(("a", "one two three"))
    edits = spark.createDataFrame(
        [("a", 0, 0, 3, "one", "1"), ("a", 1, 2, 5, "", "?"), ("a", 2, 4, 7, "zzz", "2"), ("a", 3, 8, 99, "", "3"), ("a", 4, 8, 13, "three", "3\n")],
        "path string, edit_no bigint, start_off bigint, end_off bigint, original_text string, new_text string")
    done = apply_edits(df, edits)
    assert done.first().new_content == "1 two 3\n"
    reports = edit_reports(done)
    assert rows(reports.na.fill("ok"), "edit_no", "reason") == [
        (0, "ok"), (1, "overlaps previous"), (2, "text differs"), (3, "out of bounds"), (4, "ok")]
    s = edit_statistics(reports).first()
    assert (s.total_edits, s.applied, s.skipped, s.lines_added, s.chars_added, s.chars_removed) == (5, 2, 3, 1, 3, 8)


def test_globs():
    assert re.match(glob_regex("**/*.{ts,js}"), "a/b/c.ts") and re.match(glob_regex("**/*.ts"), "c.ts")
    assert not re.match(glob_regex("*.ts"), "a/c.ts")
    with pytest.raises(ValueError):
        glob_regex("a{b")


def test_lines(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\n\n", "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.l for r in df.select("i", lines_of(F.col("t")).alias("l")).orderBy("i").collect()]
    assert got == [[], ["a"], ["a"], ["a", "b"], ["a", ""], [""]]


def test_corpus_from_folder_and_sink(spark, tmp_path):
    for path, text in {"src/a.ts": "let a;\n", "src/b.png": "x", "node_modules/x.js": "no", "yarn.lock": "l", "bin.dat": "\x01\x02\x03", "m.md": "é" * 50}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = read_corpus(spark, str(tmp_path))
    assert rows(files, "path", "language") == [("bin.dat", "unknown"), ("m.md", "unknown"), ("src/a.ts", "typescript")]
    assert rows(text_gate(files), "path") == [("m.md",), ("src/a.ts",)]
    assert rows(apply_scope(text_gate(files), "code"), "path") == [("src/a.ts",)]
    changed = files.withColumn("new_content", F.replace("content", F.lit("let"), F.lit("const")))
    target = str(tmp_path / "out")
    assert write_rewritten(changed, target).count() == 1 and not (tmp_path / "out").exists()
    write_rewritten(changed, target, dry_run=False)
    assert rows(spark.read.parquet(target), "path", "content") == [("src/a.ts", "const a;\n")]
    assert as_files(files.select("path", "content")).columns == files.columns


def test_corpus_root_that_comes_again_below(spark, tmp_path):
    for path in ("src/sub/x.ts", "src/src/sub/x.ts", "src/with space+plus%20.ts"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("a")
    assert rows(read_corpus(spark, str(tmp_path / "src"), include=["**/*.ts"]), "path") == [("src/sub/x.ts",), ("sub/x.ts",), ("with space+plus%20.ts",)]


def test_text_gate_judges_the_whole_text(spark, files_of):
    late, large = "a" * 9000 + "\x01" * 9000, "b" * 1_200_000
    assert rows(text_gate(as_files(files_of(("late", late), ("large", large)))), "path") == [("large",)]


def test_long_literals_and_markers_stay(spark, files_of):
    renames = spark.createDataFrame([("lib", "core")], "old string, new string")
    long = "f'lib/" + "y" * 1_000_100 + ".ts'"
    odd = "# x\uffffy\na = 'lib/a'\nb = 'lib/b'\n"
    out = {r.path: r.new_content for r in rw.rewrite_string_paths(files_of(("long.py", long), ("odd.py", odd)), renames).collect()}
    assert out == {"long.py": long.replace("lib/", "core/"), "odd.py": odd.replace("lib/", "core/")}
    names = spark.createDataFrame([("name",)], "name string")
    assert rows(se.symbol_occurrences(files_of(("a", "'q' \uffff name")), names), "line", "col") == [(0, 6)]


def test_table_functions(spark, files_of):
    from corpusweave.functions.sql import register

    register(spark)
    files_of(("a.py", "import os\nfrom x import y")).createOrReplaceTempView("small_files")
    got = spark.sql("select f.path, i.module_path, i.line from small_files f, lateral imports(f.content, 'python') i")
    assert rows(got, "module_path", "line") == [("os", 0), ("x", 1)]
    got = spark.sql("select m.start_off, m.matched_text from small_files f, lateral matches(f.content, '[a-z]+ort') m")
    assert rows(got, "start_off", "matched_text") == [(0, "import"), (17, "import")]
