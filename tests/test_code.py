"""Metrics, manifests, ordered windows and clones on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusweave.functions.ordered import Ordered
from corpusweave.operators import clones, edits, manifests as mf, metrics as m, symbols as sy, telemetry as t, windows as w


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def report(files):
    return m.function_report(m.function_bodies(sy.with_symbols(files)))


def test_nested_function(files_of):
    text = "function f(a, b) {\n  if (a) {\n    if (b) {\n      return 1;\n    }\n  }\n  return a && b;\n}\nfunction g() { return 0; }"
    got = {r.name: r for r in report(files_of(("a.js", text))).collect()}
    f = got["f"]
    # Two branches at depths 2 and 3 and one operator at depth 1, each plus one.
    assert (f.cyclomatic, f.cognitive, f.max_nesting, f.parameters, f.total_lines) == (4, 3 + 4 + 2, 3, 2, 8)
    assert (got["g"].cyclomatic, got["g"].cognitive, got["g"].rating, got["g"].parameters) == (1, 0, "simple", 0)


def test_else_if_and_comments(files_of):
    text = "fn f(&self, x: i32) {\n// if while\nif x > 1 { } else if x < 2 { }\n/* a\n b */\n}\n"
    r = report(files_of(("a.rs", text))).first()
    assert (r.cyclomatic, r.parameters, r.comment_lines, r.sloc) == (1 + 2 + 1, 1, 3, 3)


@pytest.mark.parametrize("score,rating", [(0, "simple"), (3, "simple"), (8, "moderate"), (15, "complex"), (25, "very_complex")])
def test_rating(spark, score, rating):
    assert spark.range(1).select(m.rating_of(F.lit(score))).first()[0] == rating


def test_issues(files_of):
    body = "\n".join("  if (a && b && c) { if (d) { x(); } }" for _ in range(25))
    r = report(files_of(("a.ts", f"export function f(a, b, c, d, e, g) {{\n{body}\n}}"))).first()
    assert r.issues == ["cognitive_complexity", "parameters", "comments"] and r.rating == "very_complex"
    assert r.recommendation.startswith("Strongly")


def test_python_end_lines(files_of):
    text = "class A:\n    def f(self):\n        x = 1\n\n    # note\n    def g(self, y):\n        return y\nLIMIT = 3\n"
    assert rows(sy.extract_symbols(files_of(("a.py", text))), "name", "kind", "line", "end_line") == [
        ("A", "class", 0, 6), ("LIMIT", "constant", 7, 7), ("f", "function", 1, 4), ("g", "function", 5, 6), ("x", "variable", 2, 2)]


def test_long_bodies_stay_whole(files_of):
    text = "def f():\n" + "    x()\n" * 900 + "def g():\n    if x:\n        pass\n"
    brace = "function h() {\n" + "  x();\n" * 900 + "}\nconst y = 1;\n"
    got = m.function_bodies(sy.with_symbols(files_of(("a.py", text), ("b.js", brace)))).select("name", F.size("body").alias("n"))
    assert rows(got, "name", "n") == [("f", 901), ("g", 3), ("h", 902)]


def test_python_body_ends_with_its_function(files_of):
    files = sy.with_symbols(files_of(("a.py", "def a():\n    return {1: 2}\n\ndef b(x):\n    if x:\n        for y in x:\n            pass\n")))
    assert rows(m.complexity(m.function_bodies(files)), "name", "cyclomatic") == [("a", 1), ("b", 3)]


def test_symbol_search_pages(files_of):
    symbols = sy.extract_symbols(files_of(("a.py", "def aa():\n  pass\ndef AAb():\n  pass\nclass Aa:\n  pass\n")))
    got = sy.search_symbols(symbols, "aa", "fn", limit=1, offset=1).collect()
    assert [(r.name, r.total) for r in got] == [("AAb", 2)]


def test_indentation(files_of):
    got = rows(m.indent_census(files_of(("a", "x\n  y\n    z"), ("b", "\tx"), ("c", "x"), ("d", " " * 6 + "a\n" + " " * 9 + "b"))), "path", "indent", "width")
    assert got == [("a", "space", 2), ("b", "tab", 1), ("c", "space", 4), ("d", "space", 3)]


def test_outline(files_of):
    got = rows(sy.outline(files_of(("a.md", "# T\ntext\n## S \n#### d\n#no"))), "position", "level", "title", "kind")
    assert got == [(0, 1, "T", "module"), (2, 2, "S", "class"), (3, 4, "d", "other")]


def test_manifests(files_of):
    files = files_of(
        ("p/Cargo.toml", '[package]\nname = "p"\n[dependencies]\na = "1"\nb = { git = "https://x/y", features = ["f"], optional = true }\n[dev-dependencies]\nc = { path = "../c" }'),
        ("q/pyproject.toml", '[project]\nname = "q"\ndependencies = ["requests>=2.0", "flask"]\n[tool.poetry.dependencies]\npython = "^3.9"'),
        ("r/package.json", '{"name": "r", "dependencies": {"x": "^1.0"}, "peerDependencies": {"y": "*"}}'),
        ("s/requirements.txt", "# c\na==1\nb[e1,e2]>=2\nc\n"), ("bad/Cargo.toml", "not [ toml"), ("t/other.txt", "x==1"))
    found = mf.read_manifests(files)
    assert [(r.manifest, r.error) for r in found.filter("error is not null").collect()] == [("bad/Cargo.toml", "cannot be read: not [ toml")]
    assert rows(found.filter("error is null"), "pkg", "section", "name", "spec") == [
        ("p", "dependencies", "a", "1"), ("p", "dependencies", "b", "git:https://x/y"), ("p", "dev-dependencies", "c", "path:../c"),
        ("q", "dependencies", "flask", "*"), ("q", "dependencies", "python", "^3.9"), ("q", "dependencies", "requests", ">=2.0"),
        ("r", "dependencies", "x", "^1.0"), ("r", "peerDependencies", "y", "*"),
        ("s", "dependencies", "a", "1"), ("s", "dependencies", "b", "2"), ("s", "dependencies", "c", "*")]


def test_versions(spark):
    want = {"^1.2.3": "1.2.3", "~2.0.0": "2.0.0", ">=3.1.4": "3.1.4", "1.2": "1.2.0", "4": "4.0.0", "1.2.3.4": "1.2.3"}
    df = spark.createDataFrame([(k,) for k in want], "spec string")
    assert {r.spec: r.normalized_version for r in mf.classify_specs(df).collect()} == want


def test_member_updates(spark):
    old = spark.createDataFrame([("w", "a", 0), ("w", "b", 1)], "workspace string, member string, position bigint")
    asked = spark.createDataFrame([("w", "b", 0), ("w", "c", 1)], "workspace string, member string, position bigint")
    added = mf.update_members(old, asked, "add").orderBy("added", "position").collect()
    assert [(r.member, r.before, r.after) for r in added] == [("a", 2, 3), ("b", 2, 3), ("c", 2, 3)]
    assert rows(mf.update_members(old, asked, "remove"), "member", "after") == [("a", 1)]
    assert rows(mf.update_members(old, asked, "list"), "member") == [("a",), ("b",)]


@pytest.fixture
def many_ranges(spark):
    """Keep AQE from merging the ranges of small data."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ordered_ranges_equal_plain_windows_on_a_hot_key(spark, many_ranges):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"k{i % 40}", rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v bigint, id bigint")
    ordered = Ordered(df, ["k"], ["v", "id"]).running_sum({"total": F.col("v")}).row_number("rank").previous("before", F.col("id"))
    blocks = ordered.rows.filter("k = 'hot'").select("_block").distinct().count()
    assert blocks > 1, "the hot key is split over several tasks"
    want = {}
    for key in {d[0] for d in data}:
        total, before = 0, None
        for rank, (_, v, i) in enumerate(sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2])), 1):
            total += v
            want[i] = (total, rank, before)
            before = i
    assert {r.id: (r.total, r.rank, r.before) for r in ordered.result().collect()} == want


def test_percentile_index(spark):
    df = spark.range(200).select(F.col("id").alias("request_id"), F.col("id").cast("double").alias("ms"))
    r = t.latency_percentiles(df).first()
    assert (r.p95_ms, r.p99_ms, r.min_ms, r.max_ms) == (190.0, 198.0, 0.0, 199.0)


def test_health_without_requests(spark):
    r = t.health(spark.createDataFrame([], "ok boolean")).first()
    assert (r.success_rate, r.status) == (100.0, "success")


def test_eviction(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("path"), F.timestamp_seconds("id").alias("cached_at"))
    assert w.evict_oldest(df, 30).count() == 3 and w.evict_oldest(df, 5).count() == 1 and w.evict_oldest(df, 31).count() == 0


def test_clones_against_brute_force(files_of):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh")
    shared = [word() for _ in range(12)]
    texts = {f"f{i}": [word() for _ in range(10)] + (shared if i < 3 else []) + [word() for _ in range(10)] for i in range(5)}
    size, seen = 6, {}
    for path, tokens in texts.items():
        for i in range(len(tokens) - size + 1):
            seen.setdefault(tuple(tokens[i : i + size]), []).append((path, i))
    flagged = {place for places in seen.values() if len(places) > 1 for place in places}
    want = set()
    for path, i in flagged:
        if (path, i - 1) not in flagged:
            n = i
            while (path, n + 1) in flagged:
                n += 1
            want.add((path, i, n - i + size))
    files = files_of(*[(p, "  ".join(tokens)) for p, tokens in texts.items()])
    assert set(rows(clones.clone_groups(files, size), "path", "start_token", "tokens")) == want
    assert clones.clone_groups(files_of(("a", "x y z")), 50).count() == 0


def test_edit_sets(spark):
    schema = "path string, edit_no bigint, start_off bigint, end_off bigint, original_text string, new_text string"
    df = spark.createDataFrame([
        ("a", 0, 0, 4, "abcd", "x"), ("a", 1, 4, 8, "efgh", "x"), ("a", 2, 6, 9, "ghi", "y"), ("a", 3, 0, 4, "abcd", "x"),
        ("b", 4, 0, 2, "ab", "z"), ("b", 5, 1, 6, "bcdef", "z"), ("b", 6, 5, 9, "fghi", "z")], schema)
    assert rows(edits.overlapping_edits(df), "path", "edit_no") == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("b", 6)]
    assert rows(edits.dedupe_edits(df), "path", "edit_no") == [("a", 0), ("a", 1), ("b", 5)]
    inserts = spark.createDataFrame([("a", 0, 3, 8, "", "x"), ("a", 1, 5, 5, "", "y"), ("a", 2, 3, 3, "", "z"), ("a", 3, 8, 8, "", "z")], schema)
    assert rows(edits.overlapping_edits(inserts), "edit_no", "meets") == [(0, 1), (1, 0)]
    with pytest.raises(Exception, match="unknown edit type"):
        edits.checked_edits(spark.createDataFrame([("zap",)], "edit_type string")).collect()


def test_slices_equal_sorting(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v"))
    want = [r.id for r in df.orderBy("v", "id").offset(300).limit(40).collect()]
    assert sorted(r.id for r in w.slice_of(df, ["v", "id"], 300, 40).collect()) == sorted(want)


def test_max_before_and_following_on_a_hot_key(spark, many_ranges):
    rng = random.Random(2)
    data = [("hot" if i % 4 else "cold", rng.randrange(1000), i) for i in range(800)]
    df = spark.createDataFrame(data, "k string, v bigint, id bigint")
    out = Ordered(df, ["k"], ["id"]).max_before("top", F.col("v")).following("nxt", F.col("v")).result()
    for key in ("hot", "cold"):
        values = [d[1] for d in data if d[0] == key]
        got = out.filter(F.col("k") == key).orderBy("id").collect()
        assert [r.top for r in got] == [max(values[:i], default=None) for i in range(len(values))]
        assert [r.nxt for r in got] == [*values[1:], None]


def test_limits_as_a_table(spark):
    rows = [("a", "x", 10, 7), ("a", "x", 4, 8), ("a", None, 99, 9), ("b", "x", 99, 1), (None, "x", 99, 2)]
    measures = spark.createDataFrame(rows, "metric string, tier string, ms bigint, extra int")
    limits = [("a", "x", 5), ("a", "x", 6), ("a", "y", 1)]
    table = spark.createDataFrame(limits, "metric string, tier string, limit_ms bigint")
    for given in (table, limits):
        assert [tuple(r) for r in t.threshold_exceedances(measures, given).collect()] == [("a", "x", 10, 7, 5)]
    assert t.threshold_exceedances(measures, table.filter("false")).count() == 0
    assert t.threshold_exceedances(measures.filter("false"), table).columns == [*measures.columns, "limit_ms"]


def test_python_signatures(files_of):
    text = ('"""doc (open\ndef no():\n"""\ndef a(x) -> int:\n    return x\n\nasync def b(\n    x: int = 1,\n    *rest,\n) -> dict[str, int]:\n    y = call(\n  1,\n        key=2,\n    )\n'
            "    return {  # (\n}\nclass C(\n    Base,\n):\n    def d(self): return ')'\n    def e(self,\n          q=(1)):\n        '''\nlow\n        '''\n        pass\nz = 1\n")
    files = files_of(("a.py", text))
    got = rows(sy.extract_symbols(files), "line", "name", "kind", "end_line")
    assert got == [(3, "a", "function", 5), (6, "b", "function", 15), (10, "y", "variable", 10), (16, "C", "class", 25), (19, "d", "function", 19),
                   (20, "e", "function", 25), (26, "z", "variable", 26)]
    counts = rows(m.parameter_count(m.function_bodies(sy.with_symbols(files))), "name", "parameters")
    assert counts == [("a", 1), ("b", 2), ("d", 0), ("e", 1)]


def test_many_functions_in_one_file(files_of):
    text = "".join(f"class K{k}:\n    def f{k}(self):\n        return {k}\n" for k in range(3000))
    got = {(r.name, r.line, r.end_line) for r in sy.extract_symbols(files_of(("a.py", text))).collect()}
    assert got == {(f"K{k}", 3 * k, 3 * k + 2) for k in range(3000)} | {(f"f{k}", 3 * k + 1, 3 * k + 2) for k in range(3000)}


def test_broken_and_target_manifests(files_of):
    cargo = ('[package]\nname = "core" # x\n[dependencies]\nserde = { version = "1.0", features = ["derive", "rc"] }\ntokio.version = "1"\ntokio.features = [\n  "full", # all\n  "rt",\n]\n'
             '[target.\'cfg(unix)\'.dependencies]\nlibc = "0.2"\n[target."x86".dev-dependencies.winapi]\nversion = \'0.3\'\n[workspace.dependencies]\na.workspace = true\n[[bin]]\nname = "b"\n')
    files = files_of(("a/Cargo.toml", cargo), ("c/Cargo.toml", "[package]\n[dependencies\nq = 1\n"), ("d/package.json", "{oops"), ("e/package.json", '{"name":"e"}'),
                     ("f/Cargo.toml", None), ("g/package.json", None), ("h/Cargo.toml", "[dependencies]\nk =\n"), ("i/package.json", '{"dependencies": "no"}'), ("j/Cargo.toml", ""))
    found = mf.read_manifests(files)
    assert sorted(r.manifest for r in found.filter("error is not null").collect()) == ["c/Cargo.toml", "d/package.json", "g/package.json", "h/Cargo.toml", "i/package.json"]
    got = [(r.section, r.name, r.spec, r.features, r.pkg) for r in found.filter("error is null").orderBy("position").collect()]
    assert got == [("dependencies", "serde", "1.0", ["derive", "rc"], "core"), ("dependencies", "tokio", "1", ["full", "rt"], "core"), ("target.cfg(unix).dependencies", "libc", "0.2", [], "core"),
                   ("target.x86.dev-dependencies", "winapi", "0.3", [], "core"), ("workspace.dependencies", "a", "*", [], "core")]
