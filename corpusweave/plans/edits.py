"""Queries over planned edits and over edits applied to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.edits import (
    apply_edits, atomic_plan_gate, contested_files, dedupe_edits, edit_reports, edit_statistics, impact_level,
    merge_plans, overlapping_edits, path_edit_warnings, plan_files, plan_overlap, plan_preview, stale_plans,
)
from ..sources.bindings import bound, oracle, table


def _edits(spark, sf):
    return bound(spark, sf, "edits")


def overlaps(spark, sf):
    return overlapping_edits(_edits(spark, sf)).select("path", "edit_no", "start_off", "end_off", "meets")


def deduped(spark, sf):
    edits = _edits(spark, sf).withColumn("start_off", F.col("start_off") * 20).withColumn(
        "end_off", F.col("start_off") + F.col("edit_no") % 900)
    return dedupe_edits(edits).select("path", "edit_no", "start_off", "end_off")


def _planned(spark, sf):
    """Four edits per document: in place, overlapping, with a wrong text, out of bounds."""
    docs = table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "doc_id", F.col("text").alias("content"))
    k = F.explode_outer(F.sequence(F.lit(0), F.lit(3))).alias("k")
    e = docs.select("path", "doc_id", "content", k).select(
        "path", "content", F.col("k").cast("bigint").alias("edit_no"),
        ((F.col("doc_id") * 37 + F.col("k") * 53) % 200).alias("start_off"),
        ((F.col("doc_id") + F.col("k")) % 90).alias("n"), ((F.col("doc_id") + F.col("k")) % 5 == 0).alias("wrong"))
    text = F.when(F.col("wrong"), "zzz").otherwise(F.substring("content", F.col("start_off").cast("int") + 1, F.col("n").cast("int")))
    edits = e.select("path", "edit_no", "start_off", (F.col("start_off") + F.col("n")).alias("end_off"),
                     text.alias("original_text"), F.concat(F.lit("<"), F.col("edit_no"), F.lit("\n>")).alias("new_text"))
    return docs.select("path", "content"), edits


def applied_documents(spark, sf):
    return apply_edits(*_planned(spark, sf)).select("path", "new_content")


def applied_reports(spark, sf):
    return edit_reports(apply_edits(*_planned(spark, sf))).select("path", "edit_no", "reason")


def statistics(spark, sf):
    reports = edit_reports(apply_edits(*_planned(spark, sf)))
    return edit_statistics(reports.withColumn("source", F.substring_index("path", "/", 1)), ("source",))


def merged(spark, sf):
    e = _edits(spark, sf)
    a, b = e.filter(F.col("category") == "import"), e.filter(F.col("category") != "import")
    return merge_plans(a, b).select("path", "edit_no", "edit_type", "apply_order")


def preview(spark, sf):
    return plan_preview(_edits(spark, sf))


def files_of_plans(spark, sf):
    return plan_files(_edits(spark, sf))


def impact(spark, sf):
    return impact_level(_edits(spark, sf), ("import", "string_literal", "documentation", "configuration", "comment"))


def warnings(spark, sf):
    return path_edit_warnings(_edits(spark, sf))


def gated(spark, sf):
    e = _edits(spark, sf).withColumn("plan_id", F.concat("plan_id", F.lit("/"), F.col("edit_no") % 50))
    return atomic_plan_gate(e).select("plan_id", "path", "edit_no")


def stale(spark, sf):
    docs = bound(spark, sf, "files")
    plans = docs.select(
        F.concat(F.lit("plan-"), "language").alias("plan_id"),
        F.when(F.length("content") % 7 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"),
        F.when(F.length("content") % 5 == 0, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(
            F.sha2("content", 256)).alias("sha256"))
    return stale_plans(plans, docs)


def shared_files(spark, sf):
    return plan_overlap(_edits(spark, sf), "plan7", "plan107")


def contested(spark, sf):
    return contested_files(_edits(spark, sf))


PLANNED = """docs as (select concat(source, '/', doc_id, '.txt') as path, doc_id, text as content from documents),
  e as (select path, content, k as edit_no, (doc_id * 37 + k * 53) % 200 as s, (doc_id + k) % 90 as n, (doc_id + k) % 5 = 0 as wrong
      from docs, range(4) t(k)),
  p as (select path, content, edit_no::bigint as edit_no, s, s + n as t, case when wrong then 'zzz' else content[s + 1:least(s + n, length(content))] end as old,
      '<' || edit_no || chr(10) || '>' as new, row_number() over (partition by path order by s, edit_no) as r from e),
  run as (select path, content, 0::bigint as r, null::bigint as edit_no, null::varchar as reason, 0::bigint as last, ''::varchar as done, 0::bigint as added, 0::bigint as removed from docs
    union all
    select p.path, p.content, p.r, p.edit_no, x.why, case when x.why is null then p.t else run.last end,
      case when x.why is null then run.done || p.content[run.last + 1:p.s] || p.new else run.done end,
      case when x.why is null then length(p.new) else 0 end, case when x.why is null then p.t - p.s else 0 end
    from run join p on p.path = run.path and p.r = run.r + 1,
      lateral (select case when p.t > length(p.content) then 'out of bounds' when p.s < run.last then 'overlaps previous'
          when p.old <> '' and p.content[p.s + 1:p.t] <> p.old then 'text differs' end as why) x)"""

PAIRS = "a.path = b.path and a.edit_no <> b.edit_no and a.start_off < b.end_off and b.start_off < a.end_off"

QUERIES = {
    "overlapping_edits": (overlaps, oracle(f"""
      , seen as (select path, edit_no, start_off, end_off,
          max(end_off * 1000000000000 + edit_no) over (partition by path order by start_off, end_off, edit_no rows between unbounded preceding and 1 preceding) as far,
          lead(edit_no) over (partition by path order by start_off, end_off, edit_no) as next from edits),
      hit as (select distinct a.path, a.edit_no from edits a join edits b on {PAIRS})
      select s.path, s.edit_no, start_off, end_off, case when far // 1000000000000 > start_off then far % 1000000000000 else next end::bigint as meets
      from seen s join hit h on s.path = h.path and s.edit_no = h.edit_no""", "edits")),
    "dedupe_edits": (deduped, oracle("""
      , base as (select path, edit_no, start_off * 20 as s, start_off * 20 + edit_no % 900 as t, original_text, new_text from edits),
      one as (select path, s, t, original_text, new_text, min(edit_no) as edit_no from base group by all),
      ranked as (select *, length(original_text) as weight, row_number() over (partition by path order by edit_no) as r from one),
      fold as (select path, 0::bigint as r, []::struct(edit_no bigint, s bigint, t bigint, weight bigint)[] as kept from (select distinct path from one)
        union all
        select f.path, q.r, case when x.i is null then list_append(f.kept, y.e) when y.e.weight > f.kept[x.i].weight
            then list_concat(f.kept[:x.i - 1], [y.e], f.kept[x.i + 1:]) else f.kept end
        from fold f join ranked q on q.path = f.path and q.r = f.r + 1,
          lateral (select {'edit_no': q.edit_no, 's': q.s, 't': q.t, 'weight': q.weight}::struct(edit_no bigint, s bigint, t bigint, weight bigint) as e) y,
          lateral (select list_position(list_transform(f.kept, lambda k: k.s < y.e.t and y.e.s < k.t), true) as i) x),
      final as (select path, unnest(kept) as k from fold f where r = (select max(r) from ranked q where q.path = f.path))
      select distinct path, k.edit_no as edit_no, k.s as start_off, k.t as end_off from final""", "edits", recursive=True)),
    "apply_edits": (applied_documents, f"""with recursive {PLANNED}
      select path, done || content[last + 1:] as new_content from run where r = 4"""),
    "edit_reports": (applied_reports, f"with recursive {PLANNED} select path, edit_no, reason from run where r > 0"),
    "edit_statistics": (statistics, f"""with recursive {PLANNED}
      select string_split(path, '/')[1] as source, count(*) as total_edits, count(*) filter (reason is null) as applied, count(*) filter (reason is not null) as skipped,
        sum(case when reason is null then 1 + has else 0 end)::bigint as lines_added, sum(case when reason is null and has > 0 then breaks + 1 else 0 end)::bigint as lines_removed,
        sum(added)::bigint as chars_added, sum(removed)::bigint as chars_removed
      from (select run.*, length(p.content[p.s + 1:p.t]) - length(replace(p.content[p.s + 1:p.t], chr(10), '')) as breaks,
          case when contains(p.content[p.s + 1:p.t], chr(10)) then 1 else 0 end as has from run join p using (path, r)) z group by 1"""),
    "merge_plans": (merged, oracle("""
      , tagged as (select *, case when category = 'import' then 0 else 1 end as o from edits),
      ranked as (select *, row_number() over (partition by path, edit_type order by o, edit_no) as first from tagged)
      select path, edit_no, edit_type, row_number() over (partition by path order by start_off desc, o, edit_no) as apply_order
      from ranked where edit_type not in ('create', 'move') or first = 1""", "edits")),
    "plan_preview": (preview, oracle("""
      select plan_id, count(distinct path) filter (edit_type = 'create') as created_files, count(distinct path) filter (edit_type in ('replace', 'move')) as modified_files,
        count(distinct path) filter (edit_type = 'delete') as deleted_files, count(distinct path) as files, count(*) as edits from edits group by 1""", "edits")),
    "plan_files": (files_of_plans, oracle("""
      select distinct plan_id, path, case edit_type when 'create' then 'created' when 'delete' then 'deleted' else 'modified' end as change from edits""", "edits")),
    "impact_level": (impact, oracle("""
      select plan_id, count(distinct path) as files, case when count(distinct path) <= 3 then 'low' when count(distinct path) <= 10 then 'medium' else 'high' end as impact,
        count(*) filter (category = 'import') as import, count(*) filter (category = 'string_literal') as string_literal, count(*) filter (category = 'documentation') as documentation,
        count(*) filter (category = 'configuration') as configuration, count(*) filter (category = 'comment') as comment from edits group by 1""", "edits")),
    "path_edit_warnings": (warnings, oracle("""
      select path, line, edit_no, original_text, 'PATH_EDIT' as code from (
        select *, row_number() over (partition by path order by line, edit_no) as r from edits
        where (path like '%.ts' or path like '%.py') and (original_text like '%/%' or original_text like '.%' or original_text like '%.ts' or original_text like '%.py')) where r = 1""", "edits")),
    "atomic_plan_gate": (gated, oracle("""
      , e as (select plan_id || '/' || (edit_no % 50) as plan_id, path, edit_no, valid from edits)
      select plan_id, path, edit_no from (select *, bool_and(valid) over (partition by plan_id) as good from e) where good""", "edits")),
    "stale_plans": (stale, oracle("""
      select 'plan-' || language as plan_id, case when length(content) % 7 = 0 then path || '.gone' else path end as path,
        case when length(content) % 7 = 0 then 'missing' else 'modified' end as state from files where length(content) % 7 = 0 or length(content) % 5 = 0""", "files")),
    "plan_overlap": (shared_files, oracle("""
      select path from edits where plan_id = 'plan7' intersect select path from edits where plan_id = 'plan107'""", "edits")),
    "contested_files": (contested, oracle("""
      select path, count(distinct plan_id) as plans from edits group by 1 having count(distinct plan_id) > 1""", "edits")),
}
