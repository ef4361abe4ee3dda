"""Corpus queries: filters, scope, text gate, lines, census."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import extension
from ..operators.metrics import language_census
from ..sources.bindings import bound, oracle
from ..sources.corpus import Scope, apply_scope, as_files, explode_lines, list_files, path_filter, text_gate


def _everything(spark, sf):
    names = ["code_corpus", "doc_corpus", "manifests"]
    parts = [bound(spark, sf, n).select("path", "content") for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ALL = "select path, content from code_corpus union all select path, content from doc_corpus union all select path, content from manifests"


def corpus_files(spark, sf):
    files = _everything(spark, sf)
    kept = files.filter(path_filter(F.col("path"), exclude=["**/d3/**", "**/*.json"], include=["proj?/**", "pkgs/**", "docs/*.md"]))
    return as_files(kept).select("path", "ext", "language", "size_bytes", "sha256")


def scoped_files(spark, sf):
    files = _everything(spark, sf)
    return apply_scope(files, Scope.preset("code", exclude=["proj1/**"])).select("path")


def text_files(spark, sf):
    # Blanks of every seventh file become control characters behind its start, so that some files are no texts.
    odd = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint") % 7 == 0
    masked = F.when(odd, F.concat(F.substring("content", 1, 40), F.translate(F.substring("content", F.lit(41), F.length("content")), " ", "\x01"))).otherwise(F.col("content"))
    files = bound(spark, sf, "files").select("path", masked.alias("content"), F.octet_length("content").cast("bigint").alias("size_bytes"))
    return text_gate(files).select("path", "size_bytes")


def file_lines(spark, sf):
    lines = explode_lines(_everything(spark, sf))
    return lines.select("path", F.col("line_no").cast("bigint").alias("line_no"), "line")


def listed_children(spark, sf):
    return list_files(bound(spark, sf, "code_corpus"), "proj2/src", recursive=True, pattern="d*/*.{ts,py}")


def languages(spark, sf):
    return language_census(_everything(spark, sf))


EXT = "regexp_extract(path, '[^/][.]([^./]+)$', 1)"
LANGUAGE = f"""case {EXT} when 'ts' then 'typescript' when 'js' then 'javascript' when 'py' then 'python'
  when 'rs' then 'rust' else 'unknown' end"""
# Lines of a text without a last empty line.
LINES = "case when content = '' then [] when content like '%' || chr(10) then string_split(content[:-2], chr(10)) else string_split(content, chr(10)) end"

QUERIES = {
    "corpus_files": (corpus_files, oracle(
        f"""select path, {EXT} as ext, {LANGUAGE} as language, octet_length(encode(content))::bigint as size_bytes, sha256(content) as sha256
        from (select path, content from code_corpus union all select path, content from doc_corpus union all select path, content from manifests)
        where path not like '%/d3/%' and path not like '%.json'
          and (path like 'proj_/%' or path like 'pkgs/%' or path like 'docs/%.md')""", "code_corpus", "doc_corpus", "manifests")),
    "scoped_files": (scoped_files, oracle(
        f"select path from ({ALL}) where {EXT} <> 'md' and path not like 'proj1/%'", "code_corpus", "doc_corpus", "manifests")),
    "text_files": (text_files, oracle(
        """select path, octet_length(encode(content))::bigint as size_bytes from (select path, case when regexp_extract(path, '([0-9]+)[.]txt$', 1)::bigint % 7 = 0
            then substr(content, 1, 40) || translate(substr(content, 41), ' ', chr(1)) else content end as content from files)
        where len(regexp_extract_all(content, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{FFFD}]')) * 20 < length(content)""", "files")),
    "file_lines": (file_lines, oracle(
        f"""select path, unnest(range(len(l)))::bigint as line_no, unnest(l) as line from (select path, {LINES} as l from ({ALL}))""",
        "code_corpus", "doc_corpus", "manifests")),
    "listed_children": (listed_children, oracle(
        """select path[11:] as path from code_corpus where path like 'proj2/src/%' and (path like '%.ts' or path like '%.py')""", "code_corpus")),
    "language_census": (languages, oracle(
        f"""select {LANGUAGE} as language, count(*) as files, sum(octet_length(encode(content)))::bigint as bytes, sum(len({LINES}))::bigint as lines
        from ({ALL}) group by 1""", "code_corpus", "doc_corpus", "manifests")),
}
