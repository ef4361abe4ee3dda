"""Queries over symbols, functions, metrics and clones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clones, metrics as m, symbols as s
from ..sources.bindings import bound, oracle, table
from .files import LANGUAGE, LINES


def _code(spark, sf):
    return bound(spark, sf, "code_corpus")


def _functions(spark, sf):
    return m.function_report(m.function_bodies(s.with_symbols(_code(spark, sf))))


def symbols(spark, sf):
    return s.extract_symbols(_code(spark, sf))


def headings(spark, sf):
    return s.outline(bound(spark, sf, "doc_corpus"))


def page_headings(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("content"))
    return s.outline(pages, html=True, keep=("page_id",)).groupBy("page_id", "level", "kind").agg(F.count("*").alias("headings"))


def symbol_page(spark, sf):
    found = s.search_symbols(s.extract_symbols(_code(spark, sf)), "calc", "fn", limit=25, offset=10)
    return found.select("path", "name", "kind", "line", "total", "offset", "limit")


def symbol_matches(spark, sf):
    return s.matching_symbols(s.extract_symbols(_code(spark, sf)), "A", "fn").union(
        s.matching_symbols(s.extract_symbols(_code(spark, sf)), "RT", "class")).select("path", "name", "line")


def lines(spark, sf):
    return m.line_metrics(_code(spark, sf))


def bodies(spark, sf):
    found = m.function_bodies(s.with_symbols(_code(spark, sf)))
    return found.select("path", "name", "line", F.size("body").cast("bigint").alias("body_lines"),
                        F.md5(F.array_join("body", "\n")).alias("digest"))


def measured(spark, sf):
    found = m.complexity(m.function_bodies(s.with_symbols(_code(spark, sf))))
    return found.select("path", "name", "line", "cyclomatic", "cognitive", "max_nesting")


def parameters(spark, sf):
    found = m.parameter_count(m.function_bodies(s.with_symbols(_code(spark, sf))))
    return found.select("path", "name", "line", "parameters")


def functions(spark, sf):
    out = _functions(spark, sf)
    return out.select("path", "name", "line", "cyclomatic", "cognitive", "max_nesting", "parameters", "total_lines", "sloc",
                      "comment_lines", "comment_ratio", "rating", F.array_join("issues", ",").alias("issues"), "recommendation")


def files(spark, sf):
    return m.file_report(_functions(spark, sf))


def _classes(spark, sf):
    # Declarations give bare names; a class prefix makes methods of them.
    return _functions(spark, sf).withColumn("name", F.when(
        (F.col("language") == "python") & (F.col("name") == "cost"), F.concat(F.lit("Part."), "name")).otherwise(F.col("name")))


def classes(spark, sf):
    out = m.class_report(_classes(spark, sf))
    return out.withColumn("class_issues", F.array_join("class_issues", ","))


def project(spark, sf):
    return m.project_report(_functions(spark, sf))


def worst_functions(spark, sf):
    return m.hotspots(_functions(spark, sf), "cognitive", 20).select("path", "name", "line", "cognitive")


def worst_per_project(spark, sf):
    out = m.hotspots(_functions(spark, sf), "cognitive", 3, per_project=True)
    return out.select("project", "rank", "path", "name", "cognitive")


def ratings(spark, sf):
    return m.rating_distribution(_functions(spark, sf))


def indents(spark, sf):
    return m.indent_census(_code(spark, sf))


def tests(spark, sf):
    return m.test_census(_code(spark, sf))


def _documents(spark, sf):
    return bound(spark, sf, "files").select("path", "content")


def clone_runs(spark, sf):
    return clones.clone_groups(_documents(spark, sf), 50)


def clone_starts(spark, sf):
    # The hashes stand for the text; the first place and the count identify a window.
    out = clones.clone_windows(_documents(spark, sf), 50)
    return out.select("places", F.col("first.path").alias("path"), F.col("first.position").alias("position"))


FLAT = f"lang as (select path, content, {LANGUAGE} as language, {LINES} as l from code_corpus), lines as (select path, language, l, unnest(range(len(l)))::bigint as line, unnest(l) as text from lang)"

SYMBOLS = f""", {FLAT},
  tagged as (select *, length(regexp_extract(text, '^(\\s*)', 1)) as indent, case
      when language = 'python' and regexp_matches(text, '^\\s*def \\w+[(]') then 'function'
      when language = 'python' and regexp_matches(text, '^\\s*class ') then 'class'
      when language = 'python' and regexp_matches(text, '^\\s*[A-Z_]+ = ') then 'constant'
      when language = 'python' and regexp_matches(text, '^\\s*\\w+ = ') then 'variable'
      when language in ('typescript', 'javascript') and regexp_matches(text, '^(export )?(async )?function ') then 'function'
      when language in ('typescript', 'javascript') and regexp_matches(text, '^class ') then 'class'
      when language in ('typescript', 'javascript') and regexp_matches(text, '^const ') then 'constant'
      when language = 'rust' and regexp_matches(text, '^(pub )?fn ') then 'function' end as kind from lines),
  named as (select *, case kind when 'function' then regexp_extract(text, '(def|function|fn) (\\w+)', 2) when 'class' then regexp_extract(text, 'class (\\w+)', 1)
      when 'constant' then regexp_extract(text, '^\\s*(const )?(\\w+)', 2) else regexp_extract(text, '^\\s*(\\w+)', 1) end as name from tagged where kind is not null),
  symbols as (select path, language, l, name, kind, line, case when language = 'python' and kind in ('function', 'class') then
      coalesce((select min(o.line) - 1 from tagged o where o.path = n.path and o.line > n.line and o.indent <= n.indent and trim(o.text) <> '' and trim(o.text) not like '#%'), len(l) - 1)
      else line end as end_line from named n)"""

BODIES = f"""{SYMBOLS},
  fns as (select path, language, name, line, case when language = 'python' then l[line + 1:end_line + 1] else l[line + 1:] end as w from symbols where kind = 'function'),
  chars as (select path, line as f, unnest(range(len(w)))::bigint as i, unnest(w) as text from fns),
  marks as (select path, f, i, p, c from (select path, f, i, unnest(range(length(b))) as p, unnest(string_split(b, '')) as c from (
      select *, regexp_replace(text, '[^{{}}]', '', 'g') as b from chars)) where c <> ''),
  depth as (select *, sum(case c when '{{' then 1 else -1 end) over (partition by path, f order by i, p) as d,
      count(*) filter (c = '{{') over (partition by path, f order by i, p) as opened from marks),
  ends as (select path, f, min(i) as e from depth where c = '}}' and d = 0 and opened > 0 group by 1, 2),
  bodies as (select fns.path, language, name, line, case when e is null then w else w[:e + 1] end as body from fns left join ends on ends.path = fns.path and ends.f = fns.line and language <> 'python')"""

WORD = "(^|[^A-Za-z0-9_])({w})($|[^A-Za-z0-9_])"


def _words(words: str) -> str:
    """How often any of the words stands alone on a line: split into words first."""
    return f"len(list_filter(regexp_extract_all(code, '[A-Za-z0-9_]+'), lambda x: x in ({words})))"


ELSE_IF = "len(regexp_extract_all(' ' || code || ' ', '[^A-Za-z0-9_]else if[^A-Za-z0-9_]'))"
AMP = "(length(text) - length(replace(text, '&&', ''))) // 2 + (length(text) - length(replace(text, '||', ''))) // 2"
COMPLEXITY = f"""{BODIES},
  bl as (select path, language, name, line, unnest(range(len(body)))::bigint as i, unnest(body) as text from bodies),
  cl as (select *, case when regexp_matches(ltrim(text), '^(//|#|\\*|/\\*)') then '' else string_split(text, '//')[1] end as code from bl),
  counted as (select path, language, name, line, i, text,
    case language when 'rust' then {_words("'if', 'for', 'while', 'match', 'case', 'catch'")} + {ELSE_IF} + {AMP}
      when 'python' then {_words("'if', 'elif', 'for', 'while', 'except', 'case', 'and', 'or'")}
      else {_words("'if', 'for', 'while', 'do', 'switch', 'case', 'catch'")} + {ELSE_IF} + {AMP} + length(text) - length(replace(text, '?', '')) end as n,
    case when regexp_matches(ltrim(text), '^(return|continue|break)') then 1 else 0 end as leave from cl),
  bc as (select path, line, i, unnest(range(length(b))) as p, unnest(string_split(b, '')) as c from (select path, line, i, regexp_replace(text, '[^{{}}]', '', 'g') as b from bl)),
  bd as (select *, sum(case c when '{{' then 1 else -1 end) over (partition by path, line order by i, p) as raw from bc where c <> ''),
  bd2 as (select *, raw - least(0, min(raw) over (partition by path, line order by i, p)) as d from bd),
  tops as (select path, line, max(d) as deepest from bd2 group by 1, 2),
  at_end as (select path, line, i, arg_max(d, p) as d from bd2 group by 1, 2, 3),
  nested as (select c.*, coalesce(last_value(e.d ignore nulls) over (partition by c.path, c.line order by c.i), 0) as depth from counted c
      left join at_end e on e.path = c.path and e.line = c.line and e.i = c.i),
  steps as (select *, n * (1 + depth) - case when leave = 1 and depth = 0 then 1 else 0 end as step from nested),
  sums as (select *, sum(step) over (partition by path, line order by i) as raw from steps),
  lows as (select *, min(raw) over (partition by path, line order by i) as low from sums),
  scored as (select path, language, name, line, (1 + sum(n))::bigint as cyclomatic, (arg_max(raw, i) - least(0, arg_max(low, i)))::bigint as cognitive from lows group by all),
  measured as (select s.*, coalesce(deepest, 0)::bigint as max_nesting from scored s left join tops t on t.path = s.path and t.line = s.line)"""

COMMENTS = """marked as (select *, trim(text, ' ' || chr(9) || chr(13)) as t, case when language = 'python' then '\"\"\"' else '/*' end as o,
      case when language = 'python' then '\"\"\"' else '*/' end as c, case when language = 'python' then '#' else '//' end as s from {source}),
  state as (select *, case when t = '' then null when contains(t, c) then 0 when contains(t, o) then 1 end as mark from marked),
  prior as (select *, coalesce(last_value(mark ignore nulls) over (partition by {keys} order by i rows between unbounded preceding and 1 preceding), 0) as inside from state),
  judged as (select *, t <> '' and (inside = 1 or contains(t, o) or starts_with(t, s) or starts_with(t, '*')) as comment from prior)"""

PARAMS = """heads as (select path, line, language, name, list_filter(body, lambda x: regexp_matches(ltrim(x), '^(pub fn |async fn |const fn |export function |export async function )')
      or starts_with(ltrim(x), case language when 'python' then 'def ' when 'rust' then 'fn ' else 'function ' end))[1] as h from bodies),
  inner_p as (select *, trim(coalesce(regexp_extract(h, '^[^(]*\\(([^)]*)\\)', 1), '')) as p from heads),
  params as (select path, name, line, case when p = '' then 0 else len(string_split(p, ',')) - case when language = 'python' and (starts_with(p, 'self,') or p = 'self') then 1
      when language = 'rust' and regexp_matches(p, '^(&self|self|&mut self)') then 1 else 0 end end::bigint as parameters from inner_p)"""

REPORT = f"""{COMPLEXITY}, {PARAMS}, {COMMENTS.format(source='bl', keys='path, line')},
  code_lines as (select path, line, count(*) as total_lines, count(*) filter (t <> '' and not comment) as sloc, count(*) filter (comment) as comment_lines from judged group by 1, 2),
  functions as (select m.*, p.parameters, total_lines, sloc, comment_lines, case when sloc > 0 then comment_lines / sloc else 0.0::double end as comment_ratio,
      case when cognitive <= 5 then 'simple' when cognitive <= 10 then 'moderate' when cognitive <= 20 then 'complex' else 'very_complex' end as rating
    from measured m join params p on p.path = m.path and p.line = m.line join code_lines k on k.path = m.path and k.line = m.line),
  report as (select *, list_filter([case when cognitive > 15 then 'cognitive_complexity' end, case when parameters > 5 then 'parameters' end,
      case when max_nesting > 4 then 'nesting' end, case when comment_ratio < 0.1 and sloc > 20 then 'comments' end], lambda x: x is not null) as issues from functions)"""

SUMMARY = """count(*) as functions, sum(cyclomatic)::bigint as total_cyclomatic, sum(cognitive)::bigint as total_cognitive, avg(cyclomatic) as avg_cyclomatic,
  avg(cognitive) as avg_cognitive, max(cyclomatic) as max_cyclomatic, max(cognitive) as max_cognitive, sum(sloc)::bigint as total_sloc, avg(sloc) as avg_sloc"""
RATING = "case when {s} <= 5 then 'simple' when {s} <= 10 then 'moderate' when {s} <= 20 then 'complex' else 'very_complex' end"

WINDOWS = """, tok as (select path, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') as t from files),
  w as (select path, i::bigint as position, array_to_string(t[i + 1:i + 50], ' ') as run from (select path, t, unnest(range(len(t) - 49)) as i from tok where len(t) >= 50)),
  rep as (select run, count(*) as places, min({'path': path, 'position': position}) as first from w group by run having count(*) > 1)"""

QUERIES = {
    "extract_symbols": (symbols, oracle(f"{SYMBOLS} select path, language, name, kind, line, end_line::bigint as end_line from symbols", "code_corpus")),
    "outline": (headings, oracle(f"""
      , h as (select path, unnest(range(len(l)))::bigint as position, unnest(l) as line from (select path, {LINES} as l from doc_corpus)),
      m as (select path, position, regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 1) as mark, trim(regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 2)) as title from h)
      select path, position, length(mark)::bigint as level, title, case length(mark) when 1 then 'module' when 2 then 'class' when 3 then 'function' else 'other' end as kind from m where mark <> ''""", "doc_corpus")),
    "page_outline": (page_headings, """select page_id, level, case level when 1 then 'module' when 2 then 'class' when 3 then 'function' else 'other' end as kind, count(*) as headings
      from (select page_id, unnest(regexp_extract_all(html, '(?is)<h([1-6])(?:\\s[^>]*)?>.*?</h[1-6]>', 1))::bigint as level from pages) group by all"""),
    "search_symbols": (symbol_page, oracle(f"""{SYMBOLS} , hit as (select path, name, kind, line from symbols where name ilike '%calc%' and kind = 'function')
      select *, (select count(*) from hit) as total, 10::bigint as "offset", 25::bigint as "limit" from (select * from hit order by path, line, name, kind limit 25 offset 10)""", "code_corpus")),
    "matching_symbols": (symbol_matches, oracle(f"{SYMBOLS} select path, name, line from symbols where (name ilike '%rt%' and kind = 'class') or (name ilike '%a%' and kind = 'function')", "code_corpus")),
    "line_metrics": (lines, oracle(f""", {FLAT}, numbered as (select *, line as i from lines), {COMMENTS.format(source='numbered', keys='path')}
      select path, language, count(*) as total_lines, count(*) filter (t <> '' and not comment) as sloc, count(*) filter (comment) as comment_lines,
        case when count(*) filter (t <> '' and not comment) > 0 then count(*) filter (comment) / count(*) filter (t <> '' and not comment) else 0.0::double end as comment_ratio
      from judged group by 1, 2""", "code_corpus")),
    "function_bodies": (bodies, oracle(f"{BODIES} select path, name, line, len(body)::bigint as body_lines, md5(array_to_string(body, chr(10))) as digest from bodies", "code_corpus")),
    "complexity": (measured, oracle(f"{COMPLEXITY} select path, name, line, cyclomatic, cognitive, max_nesting from measured", "code_corpus")),
    "parameter_count": (parameters, oracle(f"{BODIES}, {PARAMS} select * from params", "code_corpus")),
    "function_report": (functions, oracle(f"""{REPORT} select path, name, line, cyclomatic, cognitive, max_nesting, parameters, total_lines, sloc, comment_lines, comment_ratio, rating,
        array_to_string(issues, ',') as issues, case rating when 'complex' then 'Consider refactoring to reduce complexity' when 'very_complex' then 'Strongly recommended to refactor into smaller functions' end as recommendation
      from report""", "code_corpus")),
    "file_report": (files, oracle(f"""{REPORT} select path, {SUMMARY}, sum(len(issues))::bigint as issues, count(*) filter (rating in ('complex', 'very_complex')) as needs_attention from report group by 1""", "code_corpus")),
    "class_report": (classes, oracle(f"""{REPORT}, c as (select *, case when language = 'python' and name = 'cost' then 'Part' else '<module>' end as class from report)
      select path, class, min(line) as line, {SUMMARY}, {RATING.format(s='floor(avg(cognitive))')} as rating,
        array_to_string(list_filter([case when avg(cognitive) > 10 then 'average_complexity' end, case when count(*) > 20 then 'many_methods' end], lambda x: x is not null), ',') as class_issues
      from c group by 1, 2""", "code_corpus")),
    "project_report": (project, oracle(f"""{REPORT}, c as (select *, string_split(path, '/')[1] as project, regexp_extract(path, '^(.*)/', 1) as dir from report)
      select project, dir, path, grouping(project, dir, path)::bigint as level, count(*) as functions, sum(cyclomatic)::bigint as total_cyclomatic, sum(cognitive)::bigint as total_cognitive,
        max(cognitive) as max_cognitive, sum(sloc)::bigint as total_sloc, sum(len(issues))::bigint as issues from c group by rollup(project, dir, path)""", "code_corpus")),
    "hotspots": (worst_functions, oracle(f"{REPORT} select path, name, line, cognitive from report order by cognitive desc, path, line limit 20", "code_corpus")),
    "hotspots_per_project": (worst_per_project, oracle(f"""{REPORT} select * from (select string_split(path, '/')[1] as project,
        row_number() over (partition by string_split(path, '/')[1] order by cognitive desc, path, line) as rank, path, name, cognitive from report) where rank <= 3""", "code_corpus")),
    "rating_distribution": (ratings, oracle(f"""{REPORT} select string_split(path, '/')[1] as project, count(*) filter (rating = 'simple') as simple, count(*) filter (rating = 'moderate') as moderate,
        count(*) filter (rating = 'complex') as complex, count(*) filter (rating = 'very_complex') as very_complex from report group by 1""", "code_corpus")),
    "indent_census": (indents, oracle(f""", {FLAT}, k as (select path, text, length(regexp_extract(text, '^( *)', 1)) as w from lines where trim(text) <> ''),
      p as (select path, bool_or(starts_with(text, chr(9))) as tabs, list(distinct w) filter (w > 0) as ws from k group by path)
      select path, case when tabs then 'tab' else 'space' end as indent, case when tabs then 1 when ws is null then 4
        else list_max(list_filter(range(1, 60), lambda d: len(list_filter(ws, lambda w: w % d = 0)) = len(ws))) end::bigint as width from p""", "code_corpus")),
    "test_census": (tests, oracle("""
      select * from (select path, (len(string_split(content, '#[test]')) - 1)::bigint as tests, (len(string_split(content, 'assert_eq!(')) + len(string_split(content, 'assert!(')) - 2)::bigint as assertions
      from code_corpus) where tests > 0 or assertions > 0""", "code_corpus")),
    "clone_groups": (clone_runs, oracle(f"""{WINDOWS},
      hit as (select path, position, places from w join rep using (run)),
      isl as (select *, position - row_number() over (partition by path order by position) as g from hit)
      select path, min(position) as start_token, count(*) + 49 as tokens, max(places) as places from isl group by path, g""", "files")),
    "clone_windows": (clone_starts, oracle(f"{WINDOWS} select places, first.path as path, first.position as position from rep", "files")),
}
