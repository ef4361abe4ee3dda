"""Queries over imports, links and the reference graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import imports as im
from ..operators import relocate as rl
from ..operators.edits import apply_edits
from ..operators.symbols import extract_symbols
from ..sources.bindings import bound, oracle, table


def _corpus(spark, sf):
    return bound(spark, sf, "import_corpus")


def _resolved(spark, sf):
    files = _corpus(spark, sf)
    return im.resolve_imports(im.extract_imports(files), files)


def _edges(spark, sf):
    return im.edges_of(_resolved(spark, sf))


def code_imports(spark, sf):
    rows = im.extract_imports(bound(spark, sf, "code_corpus"))
    return rows.select("path", "language", "module_path", "import_type", "type_only", "line")


def bindings(spark, sf):
    rows = im.import_bindings(im.extract_imports(bound(spark, sf, "code_corpus")))
    return rows.select("path", "module_path", "line", "binding", "name", "alias", "type_only")


def markdown_links(spark, sf):
    return im.extract_links(bound(spark, sf, "doc_corpus")).groupBy("path", "kind", "target").agg(F.count("*").alias("links"))


def page_links(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), "page_id", F.col("html").alias("content"))
    links = im.extract_links(pages, html=True, keep=("page_id",))
    return links.groupBy("page_id", "target").agg(F.count("*").alias("links"))


def broken_page_links(spark, sf):
    pages = table(spark, sf, "pages")
    links = im.extract_links(pages.select("page_id", F.col("html").alias("content")), html=True, keep=("page_id",))
    paths = pages.select(F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1), "/$", "").alias("target"))
    return im.unresolved_links(links, paths).groupBy("target").agg(F.count("*").alias("links"))


def module_references(spark, sf):
    files = bound(spark, sf, "code_corpus")
    modules = files.select(F.regexp_extract("content", r"from (pkg\d+)", 1).alias("module")).distinct().union(
        files.select(F.lit("os").alias("module")).distinct()).filter("module <> ''")
    return im.scan_references(files, modules).groupBy("path", "line", "kind", "module").agg(F.count("*").alias("uses"))


def resolved_imports(spark, sf):
    return _resolved(spark, sf).select("path", "module_path", "line", "target")


def _aliased(spark, sf):
    """The corpus with half of its relative imports written through aliases."""
    files = _corpus(spark, sf)
    imports = im.extract_imports(files)
    n = F.regexp_extract("path", r"/s(\d+)\.ts$", 1).cast("int")
    spec = F.col("module_path")
    return files, imports.withColumn("module_path", F.when(n % 4 == 0, F.regexp_replace(spec, r"^\.\./", "@app/")).when(
        n % 4 == 1, F.regexp_replace(spec, r"^\.\./(m\d+)/(s\d+)$", "~$1:$2.ts")).when(
        n % 4 == 2, F.regexp_replace(spec, r"^.*/(s\d+)$", "$1.ts")).otherwise(spec))


def aliased_imports(spark, sf):
    files, imports = _aliased(spark, sf)
    aliases = spark.sql("""select * from values ('@app/*', 'src/*', 1), ('@app/*', 'lost/*', 2) as a(pattern, replacement, rank)
      """).unionByName(files.select(F.regexp_extract("path", r"(m\d+)", 1).alias("m")).distinct().select(
        F.concat(F.lit("~"), "m", F.lit(":*")).alias("pattern"), F.concat(F.lit("src/"), "m", F.lit("/*")).alias("replacement"),
        F.lit(3).alias("rank")))
    return im.resolve_imports(imports, files, aliases).select("path", "module_path", "line", "target")


def unresolved(spark, sf):
    return im.unresolved_references(_resolved(spark, sf))


def externals(spark, sf):
    return im.external_dependencies(im.extract_imports(bound(spark, sf, "code_corpus")))


def direct_importers(spark, sf):
    files = _corpus(spark, sf)
    external = im.extract_imports(files).filter(im.is_external(F.col("module_path"))).select("path")
    return g.importers(_edges(spark, sf), external)


def directory_importers(spark, sf):
    edges = _edges(spark, sf)
    dirs = edges.select(F.explode_outer(F.array(F.lit("src"), F.regexp_extract("dst", r"^(src/m\d+)/", 1))).alias("dir")).distinct()
    return g.importers_of_directory(edges, dirs).groupBy("dir").agg(F.count("*").alias("importers"), F.min("src").alias("first"))


def degrees(spark, sf):
    return g.degree(_edges(spark, sf), _corpus(spark, sf))


def _renames(spark, sf):
    return _corpus(spark, sf).select(F.regexp_extract("path", r"^(src/m\d+)/", 1).alias("old")).distinct().filter(
        F.col("old").rlike("[0149]$")).withColumn("new", F.regexp_replace("old", "^src/m", "lib/deep/n"))


def impacted(spark, sf):
    return g.rename_impact(_edges(spark, sf), _corpus(spark, sf), _renames(spark, sf))


def rewritten(spark, sf):
    moved = g.moved_paths(_corpus(spark, sf), _renames(spark, sf))
    return g.rewrite_references(_resolved(spark, sf), moved)


def _guides(spark, sf):
    _corpus(spark, sf).createOrReplaceTempView("import_corpus")
    return bound(spark, sf, "guide_corpus")


def _guide_renames(spark, sf):
    return _renames(spark, sf).union(spark.createDataFrame([("docs/g3.md", "guides/deep/three.md")], "old string, new string"))


def relocated(spark, sf):
    return rl.relocated_text(_guides(spark, sf), _guide_renames(spark, sf))


def guide_links(spark, sf):
    return rl.link_places(_guides(spark, sf).filter(rl.is_markdown(F.col("path"))))


def affected_by_broken(spark, sf):
    """Everything that depends, directly or not, on a file with a broken import."""
    resolved = _resolved(spark, sf)
    return g.reachable(im.edges_of(resolved), im.unresolved_references(resolved), reverse=True)


def chains_back(spark, sf):
    """For every import, the shortest chain that leads back to the importer."""
    edges = _edges(spark, sf)
    pairs = edges.select(F.col("dst").alias("source"), F.col("src").alias("target"))
    out = g.shortest_chain(edges, pairs)
    return out.select("source", "target", F.array_join("chain", ">").alias("chain"), "hops")


def dependency_cycles(spark, sf):
    return g.cycles(_edges(spark, sf))


def _package_graph(spark, sf):
    deps = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.explode_outer(F.array((F.col("c_custkey") * 7 + 3), (F.col("c_custkey") * 5 + 1))).alias("t"))
    return deps.select(F.concat(F.lit("pkg"), F.col("k") % 97).alias("pkg"), F.concat(F.lit("pkg"), F.col("t") % 131).alias("name"))


def workspace_edges(spark, sf):
    deps = _package_graph(spark, sf)
    return g.package_edges(deps, deps.select("pkg"))


def merges(spark, sf):
    deps = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("k"), F.floor(F.col("s_suppkey") / 2).cast("bigint").alias("t")).filter("k <> t")
    name = lambda c: F.concat(F.lit("pkg-"), F.col(c))
    edges = deps.select(name("k").alias("src"), name("t").alias("dst"))
    candidates = edges.select(F.col("dst").alias("source"), F.col("src").alias("target")).union(
        edges.select(F.col("src"), F.col("dst")))
    imports = deps.select(name("t").alias("pkg"), F.concat(F.lit("pkg_"), "k", F.lit("::run")).alias("module"))
    out = g.merge_would_cycle(edges, candidates, imports)
    return out.select("source", "target", "would_cycle", F.array_join("chain", ">").alias("chain"), "offending_modules")


def dead_symbols(spark, sf):
    files = _corpus(spark, sf)
    symbols = extract_symbols(files).filter(F.col("kind") == "function").select("path", "name")
    uses = im.import_bindings(im.extract_imports(files)).select("path", "name")
    return g.unused_symbols(symbols, uses, roots=("f1",))


def cleaned_imports(spark, sf):
    files = bound(spark, sf, "code_corpus")
    deleted = files.select(F.concat(F.lit("f"), F.regexp_extract("path", r"/c(\d+)\.", 1)).alias("name")).union(
        files.select(F.lit("type Ref").alias("name")).distinct())
    edits = g.import_cleanup(im.extract_imports(files), deleted)
    return edits.select("path", "line", "edit_type", F.regexp_replace("original_text", r"\n$", "").alias("original_text"), "new_text")


def statement_imports(spark, sf):
    rows = im.extract_imports(bound(spark, sf, "module_corpus"))
    return rows.select("path", "language", "module_path", "import_type", "type_only", "line", "start_off", "end_off")


def statement_bindings(spark, sf):
    rows = im.import_bindings(im.extract_imports(bound(spark, sf, "module_corpus")))
    return rows.select("path", "module_path", "line", "binding", "name", "alias", "type_only", "local_name")


def cleaned_texts(spark, sf):
    """Texts after deleted names have left their imports and re-exports."""
    files = bound(spark, sf, "module_corpus")
    names = [f"f{n}" for n in range(0, 19, 2)] + ["e", "Only1", "Q2", "d", "n3", "a4"]
    deleted = spark.createDataFrame([(n,) for n in names], "name string")
    edits = g.import_cleanup(im.extract_imports(files), deleted).withColumn("edit_no", F.col("start_off"))
    done = apply_edits(files, edits)
    return done.select("path", "new_content", F.size(F.filter("edits", lambda e: e["reason"].isNull())).cast("bigint").alias("applied"))


# Tokens of the module corpus, read by the checking engine: comments, strings, statements, words, and single characters.
_SKIPPED = r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|`[^`]*`"""
_TOKEN = {
    "typescript": _SKIPPED + r"""|import\s+[^'"`();]*?from\s*'[^']*';?|import\s*'[^']*';?|export\s+[^'"`();=]*?from\s*'[^']*';?"""
    r"""|require\s*\(\s*'[^']*'\s*\)|import\s*\(\s*'[^']*'\s*\)|'[^'\n]*'|\w+|.""",
    "python": r'""".*?"""|#[^\n]*|import [\w.]+(?: as \w+)?(?:, [\w.]+(?: as \w+)?)*|from [\w.]+ import (?:\([^()]*\)|\*|\w+)|\w+|.',
    "rust": r"""//[^\n]*|"[^"\n]*"|(?:pub(?:\([^)]*\))? )?use\s[^;]*;|\w+|.""",
}
_IN_SQL = " ".join("when '{}' then regexp_extract_all(content, '(?s){}')".format(k, v.replace("'", "''")) for k, v in _TOKEN.items())
STATEMENTS = r""", lang as (select path, content, case when path like '%.ts' then 'typescript' when path like '%.py' then 'python' else 'rust' end as language from module_corpus),
  cut as (select path, language, case language @TOKENS end as tokens from lang),
  tok as (select path, language, unnest(tokens) as s, generate_subscripts(tokens, 1) as i from cut),
  placed as (select *, sum(length(s)) over w as end_off, sum(length(s) - length(replace(s, chr(10), ''))) over w as breaks from tok
    window w as (partition by path order by i)),
  stmt as (select path, language, s, (end_off - length(s))::bigint as start_off, end_off::bigint as end_off,
      (breaks - (length(s) - length(replace(s, chr(10), ''))))::bigint as line,
      trim(regexp_replace(regexp_replace(s, case language when 'python' then '#[^\n]*' else '//[^\n]*' end, ' ', 'g'), '\s+', ' ', 'g')) as flat
    from placed where regexp_matches(s, '^(import|export|require|from|use|pub)\W.+', 's')),
  kinds as (select *, case when language = 'rust' then 'rust_use' when language = 'python' and s like 'from%' then 'python_from_import' when language = 'python' then 'python_import'
      when s like 'export%' then 're_export' when s like 'require%' then 'common_js' when regexp_matches(s, '^import\s*\(') then 'dynamic'
      when regexp_matches(s, '^import\s*''') then 'side_effect' when regexp_matches(s, '^import\s+type\s+\{') then 'type_only' else 'es_module' end as import_type from stmt),
  one as (select *, case import_type when 'rust_use' then replace(replace(replace(regexp_extract(flat, 'use (.*);', 1), '{ ', '{'), ', }', '}'), ' }', '}')
      when 'python_from_import' then regexp_extract(flat, 'from (\S+)', 1) else regexp_extract(flat, '''([^'']*)''', 1) end as m,
      case import_type when 'rust_use' then regexp_extract(flat, 'use (.*);', 1) when 'python_from_import' then regexp_extract(flat, ' import (.*)$', 1)
      else regexp_extract(flat, '^(?:import|export) (?:type )?(.*) from ', 1) end as clause from kinds),
  imp as (select path, language, m as module_path, import_type, import_type = 'type_only' or flat like 'export type%' as type_only, line, start_off, end_off, clause
      from one where import_type <> 'python_import'
    union all select path, language, split_part(item, ' ', 1), import_type, false, line, start_off, end_off, item
      from (select *, unnest(string_split(regexp_replace(flat, '^import ', ''), ', ')) as item from one where import_type = 'python_import')),
  item as (select *, unnest(case when import_type = 'python_import' then [clause] else regexp_extract_all(clause, '[^{}(),]+[{]?') end) as raw from imp),
  name as (select *, trim(raw) as x from item where trim(replace(raw, '{', '')) <> '' and not (import_type = 'rust_use' and raw like '%{'))""".replace("@TOKENS", _IN_SQL)


# The import corpus as rows, from its numbers instead of its text.
GRAPH = """, n as (select count(*) as c from supplier), live as (select path, regexp_extract(path, '/s([0-9]+)[.]', 1)::bigint as s from import_corpus),
  raw as (select l.path, l.s, (l.s * 7 + 3) % c + 1 as t, 0::bigint as line from live l, n union all
    select l.path, l.s, (l.s * 11 + 5) % c + 1, 1::bigint from live l, n where (l.s * 11 + 5) % c + 1 <> l.s),
  internal as (select path, '../m' || (t % 10) || '/s' || t as module_path, line, s, t from raw),
  resolved as (select i.path, i.module_path, i.line, l.path as target from internal i left join live l on l.s = i.t
    union all select path, 'lodash/fp', 2::bigint, null from live where s % 4 = 0),
  edges as (select distinct path as src, target as dst from resolved where target is not null)"""

MOVED = """, moves as (select path as old_path, regexp_replace(path, '^src/m([0-9]+)', 'lib/deep/n\\1') as new_path from live
    where regexp_matches(path, '^src/m[0149]/'))"""

QUERIES = {
    "extract_imports": (code_imports, oracle("""
      , c as (select path, content, regexp_extract(path, '/c([0-9]+)[.]', 1)::bigint as k from code_corpus)
      select path, 'typescript' as language, './c' || ((k * 7 + 3) % 500) as module_path, 'es_module' as import_type, false as type_only, 3::bigint as line from c where k % 4 = 0
      union all select path, 'typescript', 'fs', 'es_module', false, 4 from c where k % 4 = 0
      union all select path, 'typescript', '@types/react/hooks', 'es_module', false, 5 from c where k % 4 = 0
      union all select path, 'typescript', 'lodash/fp', 'common_js', false, 6 from c where k % 4 = 0
      union all select path, 'python', 'os', 'python_import', false, 3 from c where k % 4 = 1
      union all select path, 'python', 'numpy', 'python_import', false, 4 from c where k % 4 = 1
      union all select path, 'python', 'pkg' || (k % 11) || '.util', 'python_from_import', false, 5 from c where k % 4 = 1
      union all select path, 'rust', 'std::collections::HashMap', 'rust_use', false, 1 from c where k % 4 = 2
      union all select path, 'rust', 'crate::pkg' || (k % 11) || '::{Alpha, Beta as B}', 'rust_use', false, 2 from c where k % 4 = 2
      union all select path, 'javascript', '../lib/u' || (k % 17), 'es_module', false, 0 from c where k % 4 = 3
      union all select path, 'javascript', './lazy' || (k % 7), 'dynamic', false, 1 from c where k % 4 = 3""", "code_corpus")),
    "import_bindings": (bindings, oracle("""
      , c as (select path, regexp_extract(path, '/c([0-9]+)[.]', 1)::bigint as k from code_corpus)
      select path, './c' || ((k * 7 + 3) % 500) as module_path, 3::bigint as line, 'named' as binding, 'f' || ((k * 7 + 3) % 500) as name, null::varchar as alias, false as type_only from c where k % 4 = 0
      union all select path, 'fs', 4, 'namespace', 'fs', null, false from c where k % 4 = 0
      union all select path, '@types/react/hooks', 5, 'default', 'React', null, false from c where k % 4 = 0
      union all select path, '@types/react/hooks', 5, 'named', 'useState', 'st', false from c where k % 4 = 0
      union all select path, '@types/react/hooks', 5, 'named', 'Ref', null, true from c where k % 4 = 0
      union all select path, 'os', 3, 'namespace', 'os', null, false from c where k % 4 = 1
      union all select path, 'numpy', 4, 'namespace', 'np', null, false from c where k % 4 = 1
      union all select path, 'pkg' || (k % 11) || '.util', 5, 'named', 'helper', 'h', false from c where k % 4 = 1
      union all select path, 'pkg' || (k % 11) || '.util', 5, 'named', 'other', null, false from c where k % 4 = 1
      union all select path, 'std::collections::HashMap', 1, 'named', 'HashMap', null, false from c where k % 4 = 2
      union all select path, 'crate::pkg' || (k % 11) || '::{Alpha, Beta as B}', 2, 'named', 'Alpha', null, false from c where k % 4 = 2
      union all select path, 'crate::pkg' || (k % 11) || '::{Alpha, Beta as B}', 2, 'named', 'Beta', 'B', false from c where k % 4 = 2
      union all select path, '../lib/u' || (k % 17), 0, 'default', 'def' || (k % 17), null, false from c where k % 4 = 3""", "code_corpus")),
    "statement_imports": (statement_imports, oracle(STATEMENTS + """
      select path, language, module_path, import_type, type_only, line, start_off, end_off from imp""", "module_corpus")),
    "statement_bindings": (statement_bindings, oracle(STATEMENTS + r""",
      told as (select path, module_path, line, import_type, type_only, x like 'type %' as typed, regexp_replace(x, '^type ', '') as y,
          import_type in ('es_module', 'type_only') and strpos(clause, raw) < strpos(clause, '{') as lead from name)
      select path, module_path, line, binding, name, alias, type_only, case when binding <> 're_export' then coalesce(alias, name) end as local_name from (
        select path, module_path, line, case when import_type = 're_export' then 're_export' when import_type = 'python_import' then 'namespace' when lead then 'default' else 'named' end as binding,
          case when import_type = 'python_import' then coalesce(nullif(regexp_extract(y, ' as (\w+)', 1), ''), module_path)
               else regexp_extract(split_part(y, ' as ', 1), '([^:]*)$', 1) end as name,
          case when y like '% as %' and import_type <> 'python_import' then split_part(y, ' as ', 2) end as alias, type_only or typed as type_only from told)""", "module_corpus")),
    "cleaned_texts": (cleaned_texts, oracle(r""", k as (select *, regexp_extract(path, '/c([0-9]+)[.]', 1)::bigint as k, path like '%.ts' as ts, path like '%.py' as py from module_corpus),
      a as (select *, ts and (k % 19) % 2 = 0 as f_gone, ts and k % 2 = 1 as only_gone, ts and k % 3 = 2 as q_gone, py and k % 5 = 3 as n_gone, py and k % 7 = 4 as a_gone from k),
      b as (select *, case when f_gone then regexp_replace(regexp_replace(content, 'import \{[^}]*, // note from x\s+type (T\d+),\s+\} from', 'import { g' || (k % 7) || ' as h, type \1 } from'),
          'export \{ f\d+ as default, from \}', 'export { from }') else content end as c1 from a),
      c as (select *, case when ts then replace(c1, ', { e } from ' || chr(39) || './d', ' from ' || chr(39) || './d') else c1 end as c2 from b),
      d as (select *, case when only_gone then regexp_replace(c2, 'import type \{[^}]*\} from [^;]*;\n', '') else c2 end as c3 from c),
      e as (select *, case when q_gone then regexp_replace(c3, 'export type \{ Q2 \} from [^;]*;\n', '') else c3 end as c4 from d),
      f as (select *, case when py then regexp_replace(c4, 'import \([^)]*\)', case when a_gone then 'import b as c' else 'import a' || (k % 7) || ', b as c' end) else c4 end as c5 from e),
      g as (select *, case when n_gone then replace(c5, 'from m import n3', '') else c5 end as c6 from f)
      select path, c6 as new_content, case when ts then (case when f_gone then 2 else 0 end + 1 + only_gone::int + q_gone::int) else 1 + n_gone::int end::bigint as applied
      from g where ts or py""", "module_corpus")),
    "extract_links": (markdown_links, oracle("""
      , l as (select path, 'inline' as kind, unnest(regexp_extract_all(content, '!?\\[[^\\]]+\\]\\(([^)]+)\\)', 1)) as t from doc_corpus
        union all select path, 'definition', unnest(regexp_extract_all(content, '(?m)^[ \\t]*\\[[^\\]]+\\]:[ \\t]*(\\S+)', 1)) from doc_corpus
        union all select path, 'autolink', unnest(regexp_extract_all(content, '<([^>]+)>', 1)) from doc_corpus)
      select path, kind, regexp_replace(string_split(t, '#')[1], '^(\\./)+', '') as target, count(*) as links from l
      where not regexp_matches(t, '^(https?://|mailto:|ftp://|#)') group by all""", "doc_corpus")),
    "page_links": (page_links, """select page_id, target, count(*) as links from (
        select page_id, regexp_replace(string_split(t, '#')[1], '^(\\./)+', '') as target from (
          select page_id, unnest(regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1)) as t from pages)
        where not regexp_matches(t, '^(https?://|mailto:|ftp://|#)')) where target <> '' group by all"""),
    "broken_page_links": (broken_page_links, """select target, count(*) as links from (
        select regexp_replace(string_split(t, '#')[1], '^(\\./)+', '') as target from (
          select unnest(regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1)) as t from pages)
        where not regexp_matches(t, '^(https?://|mailto:|ftp://|#)')) where target <> ''
        and target not in (select regexp_replace(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/$', '') from pages) group by all"""),
    "scan_references": (module_references, oracle("""
      , c as (select path, regexp_extract(path, '/c([0-9]+)[.]', 1)::bigint as k from code_corpus where path like '%.py')
      select path, 3::bigint as line, 'declaration' as kind, 'os' as module, 1::bigint as uses from c
      union all select path, 5, 'declaration', 'pkg' || (k % 11), 1 from c
      union all select path, 5, 'qualified_path', 'pkg' || (k % 11), 1 from c
      union all select path, 14, 'string_literal', 'pkg' || (k % 11), 1 from c
      union all select path, 19, 'qualified_path', 'pkg' || (k % 11), 1 from c""", "code_corpus")),
    "resolve_imports": (resolved_imports, oracle(f"{GRAPH} select * from resolved", "import_corpus")),
    "resolve_aliased_imports": (aliased_imports, oracle(f"""{GRAPH}
      select path, case s % 4 when 0 then '@app/m' || (t % 10) || '/s' || t when 1 then '~m' || (t % 10) || ':s' || t || '.ts' when 2 then 's' || t || '.ts' else module_path end as module_path,
        line, (select l.path from live l where l.s = i.t) as target from internal i
      union all select path, 'lodash/fp', 2::bigint, null from live where s % 4 = 0""", "import_corpus")),
    "unresolved_references": (unresolved, oracle(f"{GRAPH} select path, module_path, line from resolved where target is null and module_path like '.%'", "import_corpus")),
    "external_dependencies": (externals, oracle("""
      , c as (select path, regexp_extract(path, '/c([0-9]+)[.]', 1)::bigint as k from code_corpus),
      m as (select unnest(['fs', '@types/react', 'lodash']) as package, path from c where k % 4 = 0
        union all select unnest(['os', 'numpy', 'pkg' || (k % 11) || '.util']), path from c where k % 4 = 1
        union all select 'std', path from c where k % 4 = 2)
      select package, count(distinct path) as files, count(*) as imports from m group by 1""", "code_corpus")),
    "importers": (direct_importers, oracle(f"{GRAPH} select src, dst from edges where dst in (select path from live where s % 4 = 0)", "import_corpus")),
    "importers_of_directory": (directory_importers, oracle(f"""{GRAPH}
      select dir, count(distinct src) as importers, min(src) as first from (select 'src' as dir, src from edges union all
        select regexp_extract(dst, '^(src/m[0-9]+)/', 1), src from edges) group by 1""", "import_corpus")),
    "degree": (degrees, oracle(f"""{GRAPH}
      select path, fan_in, fan_out, fan_in = 0 and fan_out = 0 as isolated from (select path,
        (select count(*) from edges where dst = path) as fan_in, (select count(*) from edges where src = path) as fan_out from live)""", "import_corpus")),
    "rename_impact": (impacted, oracle(f"""{GRAPH} {MOVED}
      select src as path, count(*) as "references" from edges where dst in (select old_path from moves) and src not in (select old_path from moves) group by 1""", "import_corpus")),
    "rewrite_references": (rewritten, oracle(f"""{GRAPH} {MOVED}
      , r as (select i.path, i.line, i.module_path, i.t, i.s % 2 = 0 and false as x, m.old_path is not null as mine, t2.old_path is not null as theirs, l.path as target
          from internal i join live l on l.s = i.t left join moves m on m.old_path = i.path left join moves t2 on t2.old_path = l.path),
      d as (select *, '/s' || t as leaf, t % 10 as f, regexp_extract(path, '^src/m([0-9]+)/', 1)::bigint as own from r)
      select path, line, 'update_import' as edit_type, module_path as original_text, new_text from (select *, case
          when mine and theirs and own = f then './s' || t when mine and theirs then '../n' || f || leaf when theirs then '../../lib/deep/n' || f || leaf
          when mine then '../../../src/m' || f || leaf else module_path end as new_text from d) where new_text <> module_path""", "import_corpus")),
    "relocated_text": (relocated, oracle(GRAPH + MOVED + r"""
      , r as (select i.path, i.line, i.module_path, i.t, m.old_path is not null as mine, t2.old_path is not null as theirs
          from internal i join live l on l.s = i.t left join moves m on m.old_path = i.path left join moves t2 on t2.old_path = l.path),
      d as (select *, '/s' || t as leaf, t % 10 as f, regexp_extract(path, '^src/m([0-9]+)/', 1)::bigint as own from r),
      e as (select path, line, module_path as o, case when mine and theirs and own = f then './s' || t when mine and theirs then '../n' || f || leaf when theirs then '../../lib/deep/n' || f || leaf
          when mine then '../../../src/m' || f || leaf else module_path end as n from d),
      code as (select c.path, coalesce(m.new_path, c.path) as new_path, content, m.old_path is not null as moved from import_corpus c left join moves m on m.old_path = c.path),
      lines as (select path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as i from code),
      done as (select l.path, string_agg(replace(text, coalesce(o, '?'), coalesce(n, '?')), chr(10) order by i) as new_content, count(*) filter (o <> n) as edits from lines l left join e on e.path = l.path and e.line = l.i - 1 group by l.path),
      guide as (select s, t, t % 10 in (0, 1, 4, 9) and t in (select s from live) as there, t in (select s from live) as known, s % 7 + 1 as other from (select s_suppkey as s, (s_suppkey * 7 + 3) % c + 1 as t from supplier, n)),
      told as (select *, case when there then 'lib/deep/n' else 'src/m' end || (t % 10) || '/s' || t || '.ts' as goal,
          'src/m' || (t % 10) || '/s' || t || '.ts' as old, s = 3 as self, other = 3 as to_self from guide),
      texts as (select 'docs/g' || s || '.md' as path, case when self then 'guides/deep/three.md' else 'docs/g' || s || '.md' end as new_path,
          case when not known then '../' || old when self then '../../' || goal else '../' || goal end as rel, case when known then goal else old end as abs, *,
          case when self and to_self then 'three.md' when to_self then '../guides/deep/three.md' when self then '../../docs/g' || other || '.md' else 'g' || other || '.md' end as peer from told),
      written as (select path, new_path, concat('# Guide ', s, chr(10), 'See [the code](', rel, '#top "title") and `[no](../src/m1/s1.ts)` or [![pic](./img.png)](/', abs, ').', chr(10), '```', chr(10),
          '[skip](../', old, ')', chr(10), '```', chr(10), '[s', t, '.ts]: ', rel, chr(10), '<', case when to_self and not self then '../' || 'guides/deep/three.md' else peer end, '> <https://example.com/src/m1/s1.ts> [here](#local)', chr(10)) as new_content,
          (case when rel <> '../' || old then 2 else 0 end + case when abs <> old then 1 else 0 end + case when peer <> 'g' || other || '.md' then 1 else 0 end)::bigint as edits from texts)
      select code.path, new_path, new_content, edits from code join done using (path) where moved or edits > 0
      union all select path, new_path, new_content, edits from written where edits > 0 or path <> new_path""", "import_corpus")),
    "link_places": (guide_links, oracle(r"""
      , g as (select *, regexp_extract(path, 'g([0-9]+)', 1)::bigint as s from guide_corpus where path like 'docs/%'),
      h as (select *, (s * 7 + 3) % (select count(*) from supplier) + 1 as t from g),
      l(kind, line, mark, skip, target) as (values
        ('inline', 1::bigint, '[the code](', 11, '../@#top'), ('inline', 1, '(./img.png', 1, './img.png'), ('inline', 1, '](/', 2, '/@'), ('definition', 5, ']: ', 3, '../@'),
        ('autolink', 6, '<g', 1, '!'), ('autolink', 6, '<https', 1, 'https://example.com/src/m1/s1.ts'), ('inline', 6, '(#local', 1, '#local'))
      select path, kind, line, goal as target, strpos(content, mark) - 1 + skip as start_off, strpos(content, mark) - 1 + skip + length(goal) as end_off from (
        select *, replace(replace(target, '@', 'src/m' || (t % 10) || '/s' || t || '.ts'), '!', 'g' || (s % 7 + 1) || '.md') as goal from h, l)""", "import_corpus", "guide_corpus")),
    "reachable": (affected_by_broken, oracle(f"""{GRAPH},
      walk as (select path, 0::bigint as depth from resolved where target is null and module_path like '.%'
        union select e.src, w.depth + 1 from walk w join edges e on e.dst = w.path where w.depth < 40)
      select path, min(depth) as depth from walk group by 1""", "import_corpus", recursive=True)),
    "shortest_chain": (chains_back, oracle(f"""{GRAPH},
      walk as (select distinct dst as source, dst as node, [dst] as chain from edges
        union all select w.source, e.dst, list_append(w.chain, e.dst) from walk w join edges e on e.src = w.node
        where not list_contains(w.chain, e.dst) and len(w.chain) < 9),
      best as (select source, node, chain, row_number() over (partition by source, node order by len(chain), chain) as r from walk)
      select b.source, b.node as target, array_to_string(b.chain, '>') as chain, (len(b.chain) - 1)::bigint as hops
      from best b join edges e on e.dst = b.source and e.src = b.node where r = 1""", "import_corpus", recursive=True)),
    "cycles": (dependency_cycles, oracle(f"""{GRAPH},
      one as (select distinct src, dst from edges),
      walk as (select src, dst from one union select w.src, o.dst from walk w join one o on o.src = w.dst),
      mutual as (select a.src as path, a.dst as other from walk a join walk b on a.src = b.dst and a.dst = b.src)
      select min(other) as cycle, path from mutual group by path""", "import_corpus", recursive=True)),
    "package_edges": (workspace_edges, """with d as (select 'pkg' || (c_custkey % 97) as pkg, 'pkg' || ((c_custkey * 7 + 3) % 131) as name from customer
        union all select 'pkg' || (c_custkey % 97), 'pkg' || ((c_custkey * 5 + 1) % 131) from customer)
      select distinct pkg as src, name as dst from d where name in (select pkg from d)"""),
    "merge_would_cycle": (merges, """with recursive e as (select s_suppkey as k, s_suppkey // 2 as t from supplier where s_suppkey <> s_suppkey // 2),
      walk as (select k, t, [k, t] as chain from e union all select w.k, e.t, list_append(w.chain, e.t) from walk w join e on e.k = w.t),
      cand as (select t as source, k as target from e union all select k, t from e)
      select 'pkg-' || c.source as source, 'pkg-' || c.target as target, w.k is not null as would_cycle,
        array_to_string(list_transform(w.chain, lambda x: 'pkg-' || x), '>') as chain,
        coalesce((select count(distinct e.k) from e where e.t = c.source and list_contains(w.chain, e.k) and e.k <> c.source), 0)::bigint as offending_modules
      from cand c left join walk w on w.k = c.target and w.t = c.source"""),
    "unused_symbols": (dead_symbols, oracle(f"""{GRAPH}
      select path, 'f' || s as name from live where s <> 1 and s not in (select t from internal)""", "import_corpus")),
    "import_cleanup": (cleaned_imports, oracle("""
      , c as (select path, regexp_extract(path, '/c([0-9]+)[.]', 1)::bigint as k from code_corpus)
      select path, 3::bigint as line, 'delete' as edit_type, 'import { f' || ((k * 7 + 3) % 500) || ' } from ' || chr(39) || './c' || ((k * 7 + 3) % 500) || chr(39) || ';' as original_text, '' as new_text from c
      where k % 4 = 0 and (k * 7 + 3) % 500 in (select k from c)
      union all select path, 5, 'replace', 'import React, { useState as st, type Ref } from ' || chr(39) || '@types/react/hooks' || chr(39) || ';',
        'import React, { useState as st } from ' || chr(39) || '@types/react/hooks' || chr(39) || ';' from c where k % 4 = 0""", "code_corpus")),
}
