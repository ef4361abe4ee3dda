"""Search and rewrite queries over documents and code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.languages import pattern_language_of
from ..operators.edits import plan_preview
from ..operators.rewrite import (
    bulk_rename, find_replace, remove_lines, rename_conflicts, replaced_text, rewrite_config_paths,
    rewrite_string_paths,
)
from ..operators.search import (
    case_style_census, literal_occurrences, literal_search, regex_search, symbol_occurrences,
)
from ..operators.symbols import extract_symbols
from ..sources.bindings import bound, oracle, table
from .files import LINES

PAIR = r"([A-Z][a-z]+) (?P<second_word>t[a-z]*)"
PAIR_SQL = "([A-Z][a-z]+) (t[a-z]*)"


def _documents(spark, sf):
    return bound(spark, sf, "files").select("path", "language", "content")


def literal_hits(spark, sf):
    return literal_search(_documents(spark, sf), "and")


def literal_words(spark, sf):
    return literal_search(_documents(spark, sf), "on", whole_word=True).select("path", "start_off", "line", "col")


def regex_hits(spark, sf):
    hits = regex_search(_documents(spark, sf), PAIR)
    return hits.select("path", "match_no", "start_off", "end_off", "line", "col", "matched_text",
                       F.get("groups", F.lit(1)).alias("first"), F.get("groups", F.lit(2)).alias("second"))


def find_replace_preview(spark, sf):
    edits = find_replace(_documents(spark, sf), "and", "und", keep=("path", "language"))
    return plan_preview(edits.withColumn("plan_id", F.col("language"))).withColumnRenamed("plan_id", "language")


def find_replace_regex(spark, sf):
    edits = find_replace(_documents(spark, sf), PAIR, "${second_word}-$1 $$0", mode="regex")
    return edits.select("path", "edit_no", "start_off", "end_off", "original_text", "new_text")


def find_replace_case(spark, sf):
    edits = find_replace(_documents(spark, sf), "(?i)the", "that_one", mode="regex", preserve_case=True)
    return edits.groupBy("original_text", "new_text").agg(F.count("*").alias("edits"))


def replaced_documents(spark, sf):
    return _documents(spark, sf).select(
        "path", replaced_text(F.col("content"), "and", "und").alias("literal"),
        replaced_text(F.col("content"), PAIR, "$2 $1", mode="regex").alias("regex"))


def rewritten_tables(spark, sf):
    """One rewrite over two text tables: hits and changed rows per table and kind."""
    docs = _documents(spark, sf).select("path", F.concat(F.lit("documents/"), "language").alias("kind"), "content")
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("path"), F.concat(F.lit("conversations/"), "role").alias("kind"), F.col("text").alias("content"))
    edits = find_replace(docs.unionByName(turns), "the", "that", whole_word=True, keep=("path", "kind"))
    per_row = edits.groupBy("kind", "path").agg(F.count("*").alias("n"))
    return per_row.groupBy("kind").agg(F.count("*").alias("changed"), F.sum("n").alias("edits"))


def case_styles(spark, sf):
    files = bound(spark, sf, "code_corpus").withColumn("language", pattern_language_of(F.col("path")))
    return case_style_census(files)


def symbol_uses(spark, sf):
    files = bound(spark, sf, "code_corpus")
    symbols = extract_symbols(files).filter(F.col("kind") == "function")
    return symbol_occurrences(files, symbols).groupBy("path", "name", "line").agg(F.count("*").alias("uses"))


def repeated_literals(spark, sf):
    return literal_occurrences(bound(spark, sf, "code_corpus"))


def lines_removed(spark, sf):
    out = remove_lines(_documents(spark, sf), lambda line: line.contains("and"))
    return out.select("path", "new_content", "removed")


def _rename_map(spark, sf):
    p = bound(spark, sf, "code_corpus").select(F.regexp_extract("path", r"/c(\d+)\.", 1).alias("k"))
    return p.select(F.explode_outer(F.array(
        F.struct(F.concat(F.lit("calc"), "k").alias("old"), F.concat(F.lit("compute"), "k").alias("new")),
        F.struct(F.concat(F.lit("Box"), "k").alias("old"), F.concat(F.lit("Crate"), F.col("k").cast("int") % 50).alias("new")),
        F.struct(F.lit("total").alias("old"), F.lit("sum_total").alias("new")))).alias("r")).select("r.*")


RENAMES = """select 'calc' || k as old, 'compute' || k as new from keys union all
  select 'Box' || k, 'Crate' || (k::int % 50) from keys union all select 'total', 'sum_total' from keys"""
KEYS = "keys as (select regexp_extract(path, '/c([0-9]+)[.]', 1) as k from code_corpus)"


def renamed_everywhere(spark, sf):
    out = bulk_rename(bound(spark, sf, "code_corpus"), _rename_map(spark, sf))
    return out.select("path", "new_content", "renamed")


def conflicting_renames(spark, sf):
    return rename_conflicts(_rename_map(spark, sf))


def _folder_map(spark, sf, template):
    ks = bound(spark, sf, "config_corpus").select(
        F.regexp_extract("content", r"src/m(\d+)", 1).alias("k")).distinct()
    return ks.select(F.format_string(template[0], "k").alias("old"), F.format_string(template[1], "k").alias("new"))


def config_paths(spark, sf):
    out = rewrite_config_paths(bound(spark, sf, "config_corpus"), _folder_map(spark, sf, ("src/m%s", "lib/n%s")))
    return out.select("path", "new_content", "changes")


def string_paths(spark, sf):
    renames = _folder_map(spark, sf, ("data/part%s", "data/component%s"))
    return rewrite_string_paths(bound(spark, sf, "code_corpus"), renames).select("path", "new_content", "changes")


HITS = """parts as (select path, content, unnest(string_split(content, '{p}')) as part, generate_subscripts(string_split(content, '{p}'), 1) as i,
    len(string_split(content, '{p}')) as n from files),
  spots as (select path, content, i, n, sum(length(part)) over (partition by path order by i)::bigint + (i - 1) * length('{p}') as start_off from parts),
  hits as (select path, content, (i - 1)::bigint as match_no, start_off, start_off + length('{p}') as end_off,
      string_split(substr(content, 1, start_off), chr(10)) as pre from spots where i < n)"""
GAPS = f"""cut as (select path, content, regexp_extract_all(content, '{PAIR_SQL}') as h, regexp_split_to_array(content, '{PAIR_SQL}') as g,
    regexp_extract_all(content, '{PAIR_SQL}', 1) as g1, regexp_extract_all(content, '{PAIR_SQL}', 2) as g2 from files),
  flat as (select path, content, unnest(range(1, len(h) + 1)) as i, unnest(h) as hit, unnest(g[1:len(h)]) as gap, unnest(g1) as first, unnest(g2) as second from cut),
  spots as (select *, (sum(length(gap) + length(hit)) over (partition by path order by i))::bigint as end_off from flat),
  hits as (select *, end_off - length(hit) as start_off, string_split(substr(content, 1, end_off - length(hit)), chr(10)) as pre from spots)"""

STYLE = """case when length({t}) = 1 then 'lower'
    when contains({t}, '_') and upper({t}) = {t} then 'screaming' when contains({t}, '_') then 'snake'
    when upper({t}) = {t} then 'upper' when lower({t}) = {t} then 'lower'
    when len(list_filter(w, lambda x: length(x) = 1)) > 0 and len(list_filter(w, lambda x: length(x) > 1)) > 1 then 'mixed'
    when upper({t}[1]) = {t}[1] then 'pascal' else 'camel' end"""

LITERAL_SQL = """("[^"\\n]*"|''[^''\\n]*''|[0-9]+([.][0-9]+)?)"""
PARITY = """(length({b}) - length(replace({b}, chr(39), ''))) % 2 = 0 and (length({b}) - length(replace({b}, '"', ''))) % 2 = 0
    and (length({b}) - length(replace({b}, chr(96), ''))) % 2 = 0"""

FLAT_LINES = f"lines as (select path, unnest(range(len(l)))::bigint as line, unnest(l) as text from (select path, {LINES} as l from code_corpus))"

QUERIES = {
    "literal_search": (literal_hits, oracle(f""", {HITS.format(p='and')}
      select path, match_no, start_off, end_off, (len(pre) - 1)::bigint as line, length(pre[-1])::bigint as col,
        (len(pre) - 1)::bigint as end_line, (length(pre[-1]) + 3)::bigint as end_col, 'and' as matched_text from hits""", "files")),
    "literal_search_words": (literal_words, oracle(f""", {HITS.format(p='on')}
      select path, start_off, (len(pre) - 1)::bigint as line, length(pre[-1])::bigint as col from hits
      where (start_off = 0 or not regexp_matches(substr(content, start_off, 1), '[\\pL\\pN_]'))
        and not regexp_matches(substr(content, end_off + 1, 1), '[\\pL\\pN_]')""", "files")),
    "regex_search": (regex_hits, oracle(f""", {GAPS}
      select path, (i - 1)::bigint as match_no, start_off, end_off, (len(pre) - 1)::bigint as line, length(pre[-1])::bigint as col,
        hit as matched_text, first, second from hits""", "files")),
    "find_replace_preview": (find_replace_preview, oracle("""
      select language, 0::bigint as created_files, count(*) as modified_files, 0::bigint as deleted_files, count(*) as files, sum(n)::bigint as edits
      from (select language, path, len(string_split(content, 'and')) - 1 as n from files) where n > 0 group by language""", "files")),
    "find_replace_regex": (find_replace_regex, oracle(f""", {GAPS}
      select path, (i - 1)::bigint as edit_no, start_off, end_off, hit as original_text, second || '-' || first || ' $0' as new_text from hits""", "files")),
    "find_replace_case": (find_replace_case, oracle("""
      select hit as original_text, case when hit = 'the' then 'thatone' when hit = 'THE' then 'THATONE' when hit = 'The' then 'ThatOne'
          when hit in ('tHe', 'thE') then 'thatOne' else 'ThatOne' end as new_text, count(*) as edits
      from (select unnest(regexp_extract_all(content, '(?i)the')) as hit from files) group by 1, 2""", "files")),
    "replaced_text": (replaced_documents, oracle(f"""
      select path, replace(content, 'and', 'und') as literal, regexp_replace(content, '{PAIR_SQL}', '\\2 \\1', 'g') as regex from files""", "files")),
    "rewrite_two_tables": (rewritten_tables, """with t as (select 'documents/' || lang as kind, doc_id::varchar as path, text from documents
        union all select 'conversations/' || role, conv_id || '/' || turn, text from conversations),
      w as (select kind, path, text, len(list_filter(regexp_extract_all(text, '[\\pL\\pN_]+'), lambda x: x = 'the')) as n from t)
      select kind, count(*) as changed, sum(n)::bigint as edits from w where n > 0 group by 1"""),
    "case_style_census": (case_styles, oracle(f"""
      , words as (select language, t, count(*) as n from (select case right(path, 3) when '.ts' then 'typescript' when '.js' then 'javascript'
            when '.py' then 'python' else 'rust' end as language, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) as t from code_corpus) group by all),
      split as (select *, regexp_extract_all(t, '[A-Z][^A-Z]*|^[^A-Z]+') as w from words)
      select language, {STYLE.format(t='t')} as style, sum(n)::bigint as uses, count(*) as identifiers from split group by all""", "code_corpus")),
    "symbol_occurrences": (symbol_uses, oracle(f""", {FLAT_LINES},
      names as (select distinct coalesce(nullif(regexp_extract(text, '^\\s*(export )?(async )?function (\\w+)', 3), ''),
          nullif(case when path like '%.py' then regexp_extract(text, '^\\s*def (\\w+)[(]', 1) else '' end, ''),
          nullif(case when path like '%.rs' then regexp_extract(text, '^(pub )?fn (\\w+)', 2) else '' end, '')) as name from lines),
      words as (select path, line, unnest(regexp_extract_all(regexp_replace(text, '"[^"]*("|$)|''[^'']*(''|$)', ' ', 'g'), '\\w+')) as name from lines)
      select path, name, line, count(*) as uses from words where name in (select name from names) group by all""", "code_corpus")),
    "literal_occurrences": (repeated_literals, oracle(f""", {FLAT_LINES},
      cut as (select path, text, regexp_extract_all(text, '{LITERAL_SQL}') as h, regexp_split_to_array(text, '{LITERAL_SQL}') as g from lines),
      flat as (select path, line_id, text, unnest(range(1, len(h) + 1)) as i, unnest(h) as literal, unnest(g[1:len(h)]) as gap
          from (select *, row_number() over () as line_id from cut)),
      spots as (select *, (sum(length(gap) + length(literal)) over (partition by line_id order by i) - length(literal))::bigint as pos from flat),
      marks as (select *, substr(text, 1, pos) as b, case when contains(text, '//') then string_split(text, '//')[1] end as c,
          case when contains(text, '/*') then string_split(text, '/*')[1] end as o from spots),
      kept as (select * from marks where not (literal similar to '[0-9].*' and gap similar to '(?s).*[A-Za-z0-9_.]')
          and {PARITY.format(b='b')} and not coalesce(pos > length(c) and {PARITY.format(b='c')}, false) and not coalesce(pos > length(o), false))
      select literal, count(*) as uses, count(distinct path) as files from kept group by literal having count(*) >= 2""", "code_corpus")),
    "remove_lines": (lines_removed, oracle(f"""
      , cut as (select path, content, {LINES} as l from files), kept as (select *, list_filter(l, lambda x: not contains(x, 'and')) as k from cut)
      select path, case when len(k) = len(l) then content when len(k) = 0 then ''
          else array_to_string(k, chr(10)) || case when content like '%' || chr(10) then chr(10) else '' end end as new_content,
        (len(l) - len(k))::bigint as removed from kept""", "files")),
    "bulk_rename": (renamed_everywhere, oracle(f""", {KEYS}, renames as ({RENAMES}), map as (select old, min(new) as new from renames group by old),
      cut as (select path, regexp_extract_all(content, '[\\pL\\pN_]+') as h, regexp_split_to_array(content, '[\\pL\\pN_]+') as g from code_corpus),
      flat as (select path, unnest(range(1, len(g) + 1)) as i, unnest(g) as gap, unnest(list_append(h, '')) as word from cut),
      done as (select path, string_agg(gap || coalesce(new, word), '' order by i) as new_content, count(new) as renamed from flat left join map on old = word group by path)
      select * from done where renamed > 0""", "code_corpus")),
    "rename_conflicts": (conflicting_renames, oracle(f""", {KEYS}, renames as ({RENAMES})
      select new, count(distinct old) as sources, min(old) as first_source, max(old) as last_source, 'BATCH_RENAME_CONFLICT' as code
      from renames group by new having count(distinct old) > 1""", "code_corpus")),
    "rewrite_config_paths": (config_paths, oracle("""
      select path, case when path like '%.yml' then replace(replace(content, '- src/m', '- lib/n'), ': src/m', ': lib/n')
          else replace(content, chr(10) || 'src/m', chr(10) || 'lib/n') end as new_content,
        case when path like '%.yml' then 2 else 1 end::bigint as changes from config_corpus""", "config_corpus")),
    "rewrite_string_paths": (string_paths, oracle("""
      select path, replace(content, chr(39) || 'data/part', chr(39) || 'data/component') as new_content, 1::bigint as changes
      from code_corpus where path like '%.py'""", "code_corpus")),
}
