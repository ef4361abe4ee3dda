"""References and graphs on small corpora."""

import random

from pyspark.sql import functions as F

from corpusweave.functions.paths import ancestors, extension, normalized, relative
from corpusweave.operators import graph as g
from corpusweave.operators import imports as im
from corpusweave.operators.symbols import extract_symbols


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def edges_from(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_imports_bindings_and_externals(files_of):
    text = "import { foo, bar } from './utils';\nimport type { MyType } from './types';\nimport React from 'react';\n"
    imports = im.extract_imports(files_of(("main.ts", text)))
    assert rows(imports, "module_path", "import_type", "line") == [
        ("./types", "type_only", 1), ("./utils", "es_module", 0), ("react", "es_module", 2)]
    assert rows(im.import_bindings(imports), "name", "binding", "type_only") == [
        ("MyType", "named", True), ("React", "default", False), ("bar", "named", False), ("foo", "named", False)]
    assert rows(im.external_dependencies(imports), "package", "files") == [("react", 1)]


def test_other_languages(files_of):
    imports = im.extract_imports(files_of(
        ("a.lua", 'local x = require("mod.x")\nrequire "y"'), ("b.sh", ". ./lib.sh\nsource 'c.sh'"),
        ("c.svelte", "<script>\nimport A from './A.svelte'\n</script>"), ("d.js", "const a = import('./z'); require('q')")))
    assert rows(imports, "path", "module_path", "import_type") == [
        ("a.lua", "mod.x", "lua_require"), ("a.lua", "y", "lua_require"), ("b.sh", "./lib.sh", "shell_source"),
        ("b.sh", "c.sh", "shell_source"), ("c.svelte", "./A.svelte", "es_module"), ("d.js", "./z", "dynamic"), ("d.js", "q", "common_js")]


def test_package_names_and_external_test(spark):
    names = {"@types/node/fs": "@types/node", "lodash/fp": "lodash", "github.com/user/repo": "github.com/user/repo", "react": "react"}
    df = spark.createDataFrame([(k,) for k in names], "m string")
    assert {r.m: r.p for r in df.select("m", im.package_name(F.col("m")).alias("p")).collect()} == names
    external = {"react": True, "@types/node": True, "lodash": True, "./component": False, "../utils": False, "src/types": False}
    df = spark.createDataFrame([(k,) for k in external], "m string")
    assert {r.m: r.p for r in df.select("m", im.is_external(F.col("m")).alias("p")).collect()} == external


def test_externals_by_language(files_of):
    imports = im.extract_imports(files_of(
        ("a.py", "from .util import a\nfrom . import b\nimport os\n"), ("b.rs", "use crate::pkg3::{Alpha, Beta as B};\nuse serde::de::Error;\n")))
    assert rows(im.external_dependencies(imports), "package", "files") == [("os", 1), ("serde", 1)]


def test_names_behind_a_namespace_import_are_used(spark):
    both = "path string, name string"
    symbols = spark.createDataFrame([("lib.ts", "used"), ("lib.ts", "dead")], both)
    uses, text = spark.createDataFrame([("a.ts", "lib")], both), spark.createDataFrame([("a.ts", "used"), ("lib.ts", "dead")], both)
    assert rows(g.unused_symbols(symbols, uses, occurrences=text), "name") == [("dead",)]


def test_resolution_order(spark, files_of):
    files = files_of(*[(p, "") for p in ("src/a.ts", "src/b.tsx", "src/b.js", "lib/b.ts", "docs/x/long.md", "docs/long.md", "src/c.rs", "src/d.ts")])
    specs = ["./b", "../lib/b", "./c", "docs/long.md", "long.md", "./none", "react", "@/d", "./d.js", "/src/a.ts"]
    imports = spark.createDataFrame([("src/a.ts", s, 0) for s in specs], "path string, module_path string, line int")
    aliases = spark.createDataFrame([("@/*", "src/*", 1)], "pattern string, replacement string, rank int")
    got = {r.module_path: r.target for r in im.resolve_imports(imports, files, aliases).collect()}
    assert got == {"./b": "src/b.tsx", "../lib/b": "lib/b.ts", "./c": "src/c.rs", "docs/long.md": "docs/long.md", "long.md": "docs/long.md",
                   "./none": None, "react": None, "@/d": "src/d.ts", "./d.js": "src/d.ts", "/src/a.ts": "src/a.ts"}


def test_links(files_of):
    text = "[a](./x.md#top) ![i](p.png) [s](https://e.x) [m](mailto:a@b) [h](#here)\n  [r]: y.md\n<z.md> <http://q>"
    assert rows(im.extract_links(files_of(("a.md", text))), "kind", "target") == [
        ("autolink", "z.md"), ("definition", "y.md"), ("inline", "p.png"), ("inline", "x.md")]


def test_paths(spark):
    row = spark.range(1).select(
        normalized(F.lit("a/./b/../../../c")).alias("n"), relative(F.lit("a/b"), F.lit("a/c/d")).alias("r"),
        relative(F.lit(""), F.lit("x/y")).alias("e"), ancestors(F.lit("a/b/c")).alias("a"), extension(F.lit("x/.env")).alias("x"),
        relative(F.lit("a/b"), F.lit("a/b/f")).alias("s")).first()
    assert list(row) == ["../c", "../c/d", "x/y", ["a", "a/b"], "", "f"]


def test_two_file_cycle_through_imports(files_of):
    files = files_of(("a.ts", "import { b } from './b';"), ("b.ts", "import { a } from './a';"), ("c.ts", "import { a } from './a';"))
    edges = im.edges_of(im.resolve_imports(im.extract_imports(files), files))
    assert rows(g.cycles(edges), "cycle", "path") == [("a.ts", "a.ts"), ("a.ts", "b.ts")]


def strong_components(nodes, edges):
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for n in nodes:
                if a in reach[n] and b not in reach[n]:
                    reach[n].add(b)
                    changed = True
    found = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    sizes = {c: list(found.values()).count(c) for c in found.values()}
    loops = {a for a, b in edges if a == b}
    return sorted((found[n], n) for n in nodes if sizes[found[n]] > 1 or n in loops), reach


def test_random_graphs_against_brute_force(spark):
    rng = random.Random(5)
    nodes = [f"n{i:02d}" for i in range(14)]
    pairs = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(20)})
    edges = edges_from(spark, pairs)
    components, reach = strong_components(nodes, pairs)
    assert rows(g.cycles(edges), "cycle", "path") == components
    sources = spark.createDataFrame([("n00",), ("n05",)], "path string")
    got = rows(g.reachable(edges, sources, per_source=True), "source", "path")
    assert got == sorted((s, n) for s in ("n00", "n05") for n in reach[s])
    again = g.reachable(edges, g.reachable(edges, sources).select("path"))
    assert rows(again, "path") == rows(g.reachable(edges, sources), "path")


def test_chain_and_merge(spark):
    edges = edges_from(spark, [("A", "B"), ("B", "C"), ("A", "D"), ("D", "C")])
    pairs = spark.createDataFrame([("A", "C"), ("C", "A"), ("A", "A")], "source string, target string")
    assert rows(g.shortest_chain(edges, pairs), "source", "target", "chain") == [("A", "A", ["A"]), ("A", "C", ["A", "B", "C"])]
    assert rows(g.has_path(edges, pairs), "source", "target", "reachable") == [("A", "A", True), ("A", "C", True), ("C", "A", False)]
    candidates = spark.createDataFrame([("C", "A"), ("A", "C")], "source string, target string")
    imports = spark.createDataFrame([("C", "B::x"), ("C", "Z::y")], "pkg string, module string")
    assert rows(g.merge_would_cycle(edges, candidates, imports), "source", "would_cycle", "offending_modules") == [("A", False, 0), ("C", True, 1)]


def test_rename_impact_and_rewrite(files_of, spark):
    files = files_of(("src/a.ts", "import { x } from './lib/x';"), ("src/lib/x.ts", "import { y } from '../y';"), ("src/y.ts", ""),
                     ("src/z.ts", "import { q } from './none';"))
    resolved = im.resolve_imports(im.extract_imports(files), files)
    renames = spark.createDataFrame([("src/lib", "core/lib")], "old string, new string")
    assert rows(g.rename_impact(im.edges_of(resolved), files, renames), "path") == [("src/a.ts",)]
    edits = g.rewrite_references(resolved, g.moved_paths(files, renames))
    assert rows(edits, "path", "original_text", "new_text") == [
        ("src/a.ts", "./lib/x", "../core/lib/x"), ("src/lib/x.ts", "../y", "../../src/y")]
    assert rows(im.unresolved_references(resolved), "path", "module_path") == [("src/z.ts", "./none")]


def test_neighbours(spark, files_of):
    edges = edges_from(spark, [("a", "d/x/1"), ("b", "d/y"), ("c", "e")])
    dirs = spark.createDataFrame([("d",), ("d/x",)], "dir string")
    assert rows(g.importers_of_directory(edges, dirs), "dir", "src") == [("d", "a"), ("d", "b"), ("d/x", "a")]
    one = spark.createDataFrame([("e",)], "path string")
    assert rows(g.importers(edges, one), "src") == [("c",)]
    assert rows(g.imports_of(edges, one.select(F.lit("a").alias("path"))), "dst") == [("d/x/1",)]
    files = files_of(("a", ""), ("e", ""), ("lone", ""))
    assert rows(g.degree(edges, files).filter("isolated"), "path") == [("lone",)]


def test_dead_code_and_cleanup(spark, files_of):
    files = files_of(
        ("utils.ts", "export function usedFunction() {}\nexport function unusedFunction() {}\nexport class UnusedClass {}"),
        ("main.ts", "import { usedFunction } from './utils';\nexport function main() { usedFunction(); }"))
    symbols = extract_symbols(files).select("path", "name")
    uses = im.import_bindings(im.extract_imports(files)).select("path", "name")
    assert rows(g.unused_symbols(symbols, uses, roots=("main",)), "name") == [("UnusedClass",), ("unusedFunction",)]
    imports = im.extract_imports(files_of(("m.ts", "import { a, b, c } from './x';\nimport { a } from './y';\nimport d from './z';")))
    gone = spark.createDataFrame([("a",), ("c",)], "name string")
    assert rows(g.import_cleanup(imports, gone), "line", "edit_type", "new_text") == [
        (0, "replace", "import { b } from './x';"), (1, "delete", "")]


def test_module_scan(spark, files_of):
    files = files_of(("a.py", "import pkg.sub\nfrom pkg import x\npkg.run('pkg/a.py')\nother.pkg.y"))
    modules = spark.createDataFrame([("pkg",), ("pkg.sub",)], "module string")
    assert rows(im.scan_references(files, modules), "line", "kind", "module") == [
        (0, "declaration", "pkg"), (0, "declaration", "pkg.sub"), (0, "qualified_path", "pkg"), (1, "declaration", "pkg"),
        (2, "qualified_path", "pkg"), (2, "string_literal", "pkg")]


def test_whole_statements(files_of):
    ts = ("/* import { no } from './no'; */\nimport {\n  a,\n  b as c, // from './note'\n  type T,\n} from './m';\nimport './side';\n"
          "export { d as default, from } from './u';\nexport * as ns from './ns';\nexport * from './all';\nexport type { Q } from './q';\n"
          "import D, { e } from './d'; import { from } from './z';\nconst s = \"import { x } from './string'\";\nconst m = require(\n  './cjs'\n), t = `\n"
          "import { y } from './template';\n`;\nimport type, { g } from './t';\nimport R, * as X from \"react\"\nimport type {\n  Only,\n} from './types';\n")
    py = ('"""\nimport no\n"""\nimport os, sys as s\nfrom .x import (\n    a, b as c,  # note\n    d,\n)\nfrom m import n  # note\nimport \\\n    long.name as ln\n'
          "if True: import q; from . import z\nraise E from e\n# import commented\nfrom star import *\n")
    rs = "use a::{\n    b::{c, d as dd}, // x\n    e as f,\n    self,\n};\npub(crate) use crate::x::Y;\n/// use doc::no;\nlet s = \"use x::y;\"; fn f<'a>() {}\nuse std::fmt;\nlet r = r#\"use raw::no;\"#;\n"
    imports = im.extract_imports(files_of(("a.ts", ts), ("b.py", py), ("c.rs", rs), ("d.ts", None), ("e.ts", ""), ("f.ts", "import './a'\r\nimport './b'\r\n")))
    of = lambda p, *c: rows(imports.filter(F.col("path") == p), *c)
    assert sorted(of("a.ts", "line", "module_path", "import_type")) == [
        (1, "./m", "es_module"), (6, "./side", "side_effect"), (7, "./u", "re_export"), (8, "./ns", "re_export"), (9, "./all", "re_export"),
        (10, "./q", "re_export"), (11, "./d", "es_module"), (11, "./z", "es_module"), (13, "./cjs", "common_js"), (18, "./t", "es_module"),
        (19, "react", "es_module"), (20, "./types", "type_only")]
    assert sorted(of("b.py", "line", "module_path")) == [
        (3, "os"), (3, "sys"), (4, ".x"), (8, "m"), (9, "long.name"), (11, "."), (11, "q"), (14, "star")]
    assert sorted(of("c.rs", "line", "module_path")) == [(0, "a::{b::{c, d as dd}, e as f, self}"), (5, "crate::x::Y"), (8, "std::fmt")]
    assert sorted(of("f.ts", "line", "start_off", "newline")) == [(0, 0, "\r\n"), (1, 14, "\r\n")]
    texts = {"a.ts": ts, "b.py": py, "c.rs": rs, "f.ts": "import './a'\r\nimport './b'\r\n"}
    assert all(texts[r.path][r.start_off : r.end_off] == r.statement for r in imports.collect())
    names = {(r.path, r.name, r.alias, r.binding) for r in im.import_bindings(imports).collect()}
    assert {("a.ts", "b", "c", "named"), ("a.ts", "T", None, "named"), ("a.ts", "d", "default", "re_export"), ("a.ts", "*", "ns", "re_export"),
            ("a.ts", "type", None, "default"), ("a.ts", "X", None, "namespace"), ("b.py", "s", None, "namespace"), ("b.py", "n", None, "named"),
            ("b.py", "d", None, "named"), ("c.rs", "c", None, "named"), ("c.rs", "d", "dd", "named"), ("c.rs", "fmt", None, "named")} <= names
    assert not {n for _, n, _, _ in names} & {"no", "x", "y", "n  # note", "commented"}


def test_import_cleanup_over_lines(spark, files_of):
    from corpusweave.operators.edits import apply_edits

    files = files_of(("a.ts", "import {\n  a,\n  b as c,\n} from './m';\nimport D, { a } from './d';\nexport { a } from './e';\nrest;\n"),
                     ("b.py", "from m import (\n    a,  # one\n    z,\n)\nfrom n import a\nx = 1\n"))
    gone = spark.createDataFrame([("a",), ("b",)], "name string")
    edits = g.import_cleanup(im.extract_imports(files), gone).withColumn("edit_no", F.col("start_off"))
    got = {r.path: r.new_content for r in apply_edits(files, edits).collect()}
    assert got == {"a.ts": "import D from './d';\nrest;\n", "b.py": "from m import z\nx = 1\n"}


def test_long_texts_do_not_overflow(files_of):
    text = "x" * 300_000 + "\nimport a from './b'\n" + "'" + "y " * 100_000 + "'\n" + "// c\n" * 20_000 + "import {" + "n, " * 20_000 + "} from './c'"
    assert rows(im.extract_imports(files_of(("a.ts", text))), "module_path") == [("./b",), ("./c",)]


def test_links_have_places(files_of):
    from corpusweave.operators.relocate import link_places

    text = ("# T\n[a](./x.md#top) ![i](p.png \"t\") `[no](n.md)`\n```\n[no](n.md)\n```\n[![in](q.png)](y.md)\n<!-- [no](n.md) -->\n [x.md]: x.md\n<z.md>\n"
            "  ~~~ sh\n<no>\n  ~~~\nend [b](<w.md>) ``x ` [no](n.md)``")
    got = link_places(files_of(("a.md", text), ("b.md", None), ("c.md", "")))
    assert rows(got, "line", "kind", "target") == [
        (1, "inline", "./x.md#top"), (1, "inline", "p.png"), (5, "inline", "q.png"), (5, "inline", "y.md"), (7, "definition", "x.md"), (8, "autolink", "z.md"), (12, "inline", "w.md")]
    assert all(text[r.start_off : r.end_off] == r.target for r in got.collect())


def test_relocated_text(spark, files_of):
    from corpusweave.operators.relocate import relocated_text

    files = files_of(
        ("src/a.ts", "import {\n  x\n} from './lib/x';\nexport * from './lib/x';\nconst q = require('./lib/x'); // './lib/x'\n"), ("src/lib/x.ts", "import { y } from '../y';"), ("src/y.ts", ""),
        ("docs/g.md", "[x](../src/lib/x.ts#l) [h](h.md?v=1) [r](/src/lib/x.ts) [n](../none.md)\n```\n[x](../src/lib/x.ts)\n```\n"), ("docs/h.md", "[g](./g.md)"), ("z.md", "nothing"))
    renames = spark.createDataFrame([("src/lib", "core/lib"), ("docs/h.md", "h.md")], "old string, new string")
    got = {r.path: (r.new_path, r.new_content) for r in relocated_text(files, renames).collect()}
    assert got == {
        "src/a.ts": ("src/a.ts", "import {\n  x\n} from '../core/lib/x';\nexport * from '../core/lib/x';\nconst q = require('../core/lib/x'); // './lib/x'\n"),
        "src/lib/x.ts": ("core/lib/x.ts", "import { y } from '../../src/y';"),
        "docs/g.md": ("docs/g.md", "[x](../core/lib/x.ts#l) [h](../h.md?v=1) [r](/core/lib/x.ts) [n](../none.md)\n```\n[x](../src/lib/x.ts)\n```\n"),
        "docs/h.md": ("h.md", "[g](./docs/g.md)")}


def test_cycles_of_random_graphs_against_reachability(spark):
    chance = random.Random(5)
    for nodes, links in ((30, 36), (25, 60)):
        pairs = {(f"g{chance.randrange(nodes):02}", f"g{chance.randrange(nodes):02}") for _ in range(links)}
        pairs |= {(f"r{k}", f"r{(k + 1) % 7}") for k in range(7)} | {("g00", "r3"), ("p", "q"), ("q", "p"), ("q", "r0"), ("r5", "t"), ("t", "u")}
        reach = {x: {x} for p in pairs for x in p}
        for _ in reach:
            for a, b in pairs:
                reach[a] |= reach[b]
        groups = {x: sorted(y for y in reach[x] if x in reach[y]) for x in reach}
        want = {(m[0], x) for x, m in groups.items() if len(m) > 1 or (x, x) in pairs}
        found = g.cycles(spark.createDataFrame(sorted(pairs), "src string, dst string")).collect()
        assert {(r.cycle, r.path) for r in found} == want and len(found) == len(want)


def test_long_rings_settle_in_few_rounds(spark):
    n = 5000
    ring = spark.range(n).selectExpr("concat('n', id) as src", f"concat('n', (id + 1) % {n}) as dst")
    tail = spark.range(n).selectExpr("concat('t', id) as src", "concat('t', id + 1) as dst")
    records = []
    assert g._reduced(ring.union(tail), records).isEmpty() and len(records) < 30
    found = g._restored(spark.createDataFrame([], "path string, label string"), records)
    assert found.agg(F.count("*"), F.countDistinct("path"), F.countDistinct("label")).first() == (n, n, 1)
    assert g.cycles(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_import_cleanup_extracts_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(path):
        runs.add(1)
        return path

    row = ("a.ts", "es_module", "{ a, b }", 1, 0, 26, 'import { a, b } from "./x"', "\n")
    names = "path string, import_type string, clause string, line int, start_off int, end_off int, statement string, newline string"
    imports = spark.createDataFrame([row], names).withColumn("path", F.udf(counted)("path"))
    found = g.import_cleanup(imports, spark.createDataFrame([("a",)], "name string")).collect()
    assert [r.new_text for r in found] == ['import { b } from "./x"'] and runs.value == 1


def test_chains_are_written_without_rings(spark, monkeypatch):
    """Searches of many pairs write edges, pairs and chains, and no ring of nodes; chains are those of joins, which larger graphs take."""
    from corpusweave.session import checkpoint_dir

    n = 60
    names = [f"n{k}é" for k in range(n)]
    links = [(names[k], names[(k * a + b) % n]) for k in range(n) for a, b in ((7, 3), (11, 5))] + [(names[0], x) for x in names[40:]] + [(None, "n1é"), ("n1é", None)]
    edges = edges_from(spark, links)
    pairs = edges.selectExpr("dst as source", "src as target").union(spark.createDataFrame([("n1é", "n1é"), ("n1é", "none"), ("none", "none")], "source string, target string"))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tables = lambda: {f.getPath().getName() for f in files.listStatus(folder)}
    had = tables()
    found = rows(g.shortest_chain(edges, pairs), "source", "target", "chain", "hops")
    assert len(tables() - had) <= 3 and max(r[3] for r in found) > 2
    near = rows(g.shortest_chain(edges, pairs, 2), "source", "target", "chain", "hops")
    assert near == [r for r in found if r[3] <= 2]
    monkeypatch.setattr(g, "HELD_EDGES", 0)
    assert rows(g.shortest_chain(edges, pairs), "source", "target", "chain", "hops") == found


def test_searches_of_batches_against_brute_force():
    import numpy as np
    import pyarrow as pa

    from corpusweave.operators.chains import Graph, search

    chance = random.Random(6)
    for trial in range(60):
        names = [f"{chance.choice('abzé')}{k}" for k in range(chance.randrange(2, 30))]
        links = {(chance.choice(names), chance.choice(names)) for _ in range(chance.randrange(1, 4 * len(names)))}
        links |= {(names[0], x) for x in names} if trial % 3 == 0 else set()
        graph = Graph(pa.table({"src": [a for a, _ in links], "dst": [b for _, b in links]}))
        order = graph.names.to_pylist()
        pairs = sorted({p for p in ((chance.choice(order), chance.choice(order)) for _ in range(40)) if p[0] != p[1]})
        want = set()
        for s, t in pairs:
            ring, seen = {s: (s,)}, {s}
            while ring and t not in ring:
                ways = sorted((c + (b,) for a, c in ring.items() for x, b in links if x == a and b not in seen), key=lambda c: [x.encode() for x in c], reverse=True)
                ring = {c[-1]: c for c in ways}
                seen |= set(ring)
            want |= {ring[t]} if t in ring else set()

        def searched(some, most):
            got = search(graph, *(np.array([order.index(p[k]) for p in some]) for k in (0, 1)), most=most)
            if got is None:
                return searched(some[: len(some) // 2], most) + searched(some[len(some) // 2 :], most)
            return [tuple(order[k] for k in c) for chains in got[1] for c in chains.tolist()]

        for most in (1 << 20, 6):
            got = searched(pairs, most) if pairs else []
            assert set(got) == want and len(got) == len(want)
