"""Queries over requests, operations, runs, snapshots, and batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import micros
from ..operators import snapshots as sn, telemetry as t, windows as w
from ..operators.imports import edges_of, extract_imports, resolve_imports
from ..session import checkpoint_dir
from ..sources.bindings import bound, oracle, table
from ..streaming import changes as ch, progress as pr, requests as rq
from ..streaming.edge_store import EdgeStore


def _us(c):
    return micros(F.col(c))


def dispatch(spark, sf):
    return w.queue_order(bound(spark, sf, "operations")).select("op_id", "priority", "dispatch_rank")


def latency(spark, sf):
    return w.running_latency(bound(spark, sf, "requests")).select("request_id", "mean_ms", "plugin_mean_ms")


def evicted(spark, sf):
    index = bound(spark, sf, "requests").select(F.col("request_id").cast("string").alias("path"), F.col("ts").alias("cached_at"))
    return w.evict_oldest(index, 500).select("path", _us("cached_at").alias("cached_us"))


def paged(spark, sf):
    return w.page(bound(spark, sf, "requests").select("request_id", "plugin", "ms"), [F.col("ms").desc(), "request_id"], 40, 20)


def slow_runs(spark, sf):
    return w.slowest(bound(spark, sf, "runs"))


def requests(spark, sf):
    return t.request_metrics(bound(spark, sf, "requests"))


def healthy(spark, sf):
    return t.health(bound(spark, sf, "requests"))


def percentiles(spark, sf):
    return t.latency_percentiles(bound(spark, sf, "requests"), ("plugin",))


def overall_percentiles(spark, sf):
    return t.latency_percentiles(bound(spark, sf, "requests"))


def cache(spark, sf):
    return t.cache_effectiveness(table(spark, sf, "events").select("event_type", (F.col("value") < 20).alias("hit")), ("event_type",))


def queue(spark, sf):
    ops = bound(spark, sf, "operations").withColumn("wait_s", F.when(F.col("op_id") % 7 != 0, F.col("wait_s") * 12))
    return t.queue_stats(ops, ("op_type",))


def run_totals(spark, sf):
    return t.run_report(bound(spark, sf, "runs"))


def exceeded(spark, sf):
    measures = bound(spark, sf, "runs").select(
        "run_id", F.when(F.col("run_id") % 2 == 0, "prune_planning").otherwise("directory_move_convert").alias("metric"),
        F.when(F.col("run_id") % 2 == 0, "500").otherwise("default").alias("tier"), (F.col("operation_ms") % 600).alias("ms"))
    return t.threshold_exceedances(measures)


def exceeded_by_table(spark, sf):
    """Waits above half the longest of their kind and priority."""
    measures = bound(spark, sf, "operations").select(
        "op_id", F.col("op_type").alias("metric"), F.col("priority").cast("string").alias("tier"), F.col("wait_s").alias("ms"))
    limits = measures.groupBy("metric", "tier").agg(F.floor(F.max("ms") / 2).cast("bigint").alias("limit_ms"))
    return t.threshold_exceedances(measures, limits)


def _diagnostics(spark, sf):
    d = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 300).alias("code"), F.col("o_orderpriority").alias("message"), (F.floor("o_totalprice") % 2).alias("side"))
    return d.filter("side = 0").drop("side"), d.filter("side = 1").drop("side")


def regressed(spark, sf):
    return t.regressions(*_diagnostics(spark, sf))


def gated(spark, sf):
    return t.gate(*_diagnostics(spark, sf))


def _snapshots(spark, sf):
    docs = bound(spark, sf, "files").select("path", "content", F.length("content").alias("n"))
    old = docs.filter("n % 10 <> 1").select("path", F.sha2("content", 256).alias("sha256"))
    new = docs.filter("n % 10 <> 2").select("path", F.sha2(F.when(F.col("n") % 10 == 3, F.concat("content", F.lit("."))).otherwise(F.col("content")), 256).alias("sha256"))
    return old, new


def diffed(spark, sf):
    return sn.snapshot_diff(*_snapshots(spark, sf))


def reindexed(spark, sf):
    files = bound(spark, sf, "import_corpus")
    edges = edges_of(resolve_imports(extract_imports(files), files))
    # Files of every third folder are rewritten to keep their first import only.
    changed = files.filter(F.col("path").rlike("^src/m[0369]/")).withColumn("content", F.substring_index("content", "\n", 1))
    fresh = edges_of(resolve_imports(extract_imports(changed), files))
    return sn.incremental_reindex(edges, changed.select("path"), fresh)


def stored_edges(spark, sf):
    """Edges after three batches: first texts, changes with late versions, and removals with returns to the first text."""
    import uuid

    files = bound(spark, sf, "import_corpus").withColumn("n", F.regexp_extract("path", r"/s(\d+)[.]", 1).cast("bigint"))
    store = EdgeStore(spark, f"{checkpoint_dir(spark)}/edge-store-{uuid.uuid4().hex}", 8)

    def version(rows, second, content, deleted=False):
        return rows.select("path", content.alias("content"), F.sha2(content, 256).alias("sha256"),
                           F.timestamp_seconds(F.lit(second)).alias("modified_at"), F.lit(deleted).alias("deleted"))

    whole, first = F.col("content"), F.substring_index("content", "\n", 1)
    changed = files.filter(F.col("path").rlike("^src/m[0369]/"))
    store.apply(version(files, 1000, whole), 0)
    store.apply(version(changed, 1010, first).unionByName(version(files.filter(F.col("path").rlike("^src/m1/")), 990, F.lit(""))), 1)
    store.compact()
    store.apply(version(files.filter("n % 4 = 1"), 1020, F.lit(None).cast("string"), True).unionByName(
        version(changed.filter("n % 10 = 3 and n % 4 <> 1"), 1020, whole)), 2)
    return store.edges()


def stale_entries(spark, sf):
    index = bound(spark, sf, "requests").select("request_id", F.col("ts").alias("cached_at"))
    return sn.expired(index, F.lit("2024-01-20 12:00:00").cast("timestamp")).select("request_id")


def tasks(spark, sf):
    return pr.progress_state(bound(spark, sf, "progress"))


def stalled(spark, sf):
    out = pr.stalled_tasks(bound(spark, sf, "progress"), "12 hours")
    return out.select("token", "begin_id", "title", "state", "reason")


def percentages(spark, sf):
    events = bound(spark, sf, "progress").withColumn("percentage", (F.col("event_id") % 101).cast("int"))
    return pr.progress_state(events).groupBy("state", "percentage").agg(F.count("*").alias("tasks"), F.min("token").alias("first"))


def alerts(spark, sf):
    out = pr.task_alerts(bound(spark, sf, "progress"), "1 hour", "12 hours")
    return out.select("token", "begin_id", "title", "level", "reason", _us("at").alias("at_us"))


def paired(spark, sf):
    events = table(spark, sf, "events")
    sent = events.select(F.col("event_id").alias("request_id"), F.col("ts").alias("req_ts"))
    # Every response comes `value` seconds after its request; some never come.
    answers = events.filter("event_type <> 'view'").select(
        F.col("event_id").alias("request_id"), F.timestamp_micros(_us("ts") + F.round(F.col("value") * 2_000_000).cast("bigint")).alias("resp_ts"))
    return rq.pair_requests(sent, answers).select("request_id", "status", "ms")


def windows(spark, sf):
    out = rq.windowed_metrics(bound(spark, sf, "requests"), "1 hour")
    return out.select(_us("window_start").alias("window_us"), "plugin", "requests", "ok", "mean_ms", "max_ms")


def sliding(spark, sf):
    out = rq.windowed_metrics(bound(spark, sf, "requests"), "2 hours", "1 hour")
    return out.select(_us("window_start").alias("window_us"), "plugin", "requests", "ok")


def throttled(spark, sf):
    changes = bound(spark, sf, "operations").select(F.col("op_type").alias("project"), "path", F.col("created_at").alias("ts"))
    out = ch.throttled_changes(changes, "2 hours")
    return out.select(_us("refresh_start").alias("refresh_us"), "project", "path", "changes")


def write_units(spark, sf):
    return ch.batched_writes(bound(spark, sf, "operations"), 3600).select("op_id", "path", "unit", "position")


def write_sessions(spark, sf):
    out = ch.batched_write_units(bound(spark, sf, "operations"), 3600)
    return out.select("path", _us("unit_start").alias("start_us"), _us("unit_end").alias("end_us"), "operations", "first_op", "last_op")


MEAN = "(sum(ms::decimal(18,6))::double / count(*))"
PCT = """select {k} count(*) as requests, min(ms) as min_ms, (sum(ms::decimal(18,6))::double / count(*)) as mean_ms, max(ms) as max_ms,
  list_sort(list(ms))[(count(*) * 95) // 100 + 1] as p95_ms, list_sort(list(ms))[(count(*) * 99) // 100 + 1] as p99_ms from requests {g}"""
DIAG = """with d as (select o_custkey % 300 as code, o_orderpriority as message, floor(o_totalprice)::bigint % 2 as side from orders)"""
SESSIONS = """, p as (select *, lag(created_at) over (partition by path order by created_at, op_id) as prev from operations),
  f as (select *, case when prev is null or epoch_us(created_at) - epoch_us(prev) >= 3600000000 then 1 else 0 end as opens from p),
  u as (select *, (sum(opens) over (partition by path order by created_at, op_id))::bigint as unit from f)"""

QUERIES = {
    "queue_order": (dispatch, oracle("select op_id, priority, row_number() over (order by priority, created_at, op_id) as dispatch_rank from operations", "operations")),
    "running_latency": (latency, oracle("""
      select request_id, sum(ms::decimal(18,6)) over (order by ts, request_id)::double / row_number() over (order by ts, request_id) as mean_ms,
        sum(ms::decimal(18,6)) over (partition by plugin order by ts, request_id)::double / row_number() over (partition by plugin order by ts, request_id) as plugin_mean_ms from requests""", "requests")),
    "evict_oldest": (evicted, oracle("select request_id::varchar as path, epoch_us(ts) as cached_us from requests order by ts, request_id::varchar limit 50", "requests")),
    "page": (paged, oracle("""select request_id, plugin, ms, (select count(*) from requests) as total, 40::bigint as "offset", 20::bigint as "limit"
      from (select * from requests order by ms desc, request_id limit 20 offset 40)""", "requests")),
    "slowest": (slow_runs, oracle("""
      , r as (select project, 'total_ms' as measure, row_number() over (partition by project order by total_ms desc, run_id) as rank, run_id, test_name, total_ms as ms from runs
        union all select project, 'operation_ms', row_number() over (partition by project order by operation_ms desc, run_id), run_id, test_name, operation_ms from runs)
      select * from r where rank <= 5""", "runs")),
    "request_metrics": (requests, oracle(f"""select plugin, count(*) as requests, count(*) filter (ok) as ok, count(*) filter (not ok) as failed, {MEAN} as mean_ms from requests group by rollup(plugin)""", "requests")),
    "health": (healthy, oracle("""
      , s as (select count(*) as requests, count(*) filter (ok) as ok from requests), r as (select *, case when requests > 0 then ok / requests * 100.0::double else 100.0::double end as success_rate from s)
      select *, case when success_rate >= 95 then 'success' when success_rate >= 75 then 'warning' else 'error' end as status from r""", "requests")),
    "latency_percentiles": (percentiles, oracle(PCT.format(k="plugin,", g="group by plugin"), "requests")),
    "overall_percentiles": (overall_percentiles, oracle(PCT.format(k="", g=""), "requests")),
    "cache_effectiveness": (cache, """select event_type, count(*) filter (value < 20) as hits, count(*) filter (not value < 20) as misses,
        (count(*) filter (value < 20) / count(*)) * 100.0::double as hit_ratio from events group by 1"""),
    "queue_stats": (queue, oracle("""
      , o as (select op_type, case when op_id % 7 <> 0 then wait_s * 12 end as wait from operations)
      select op_type, count(*) as operations, count(*) filter (wait is null) as pending, count(*) filter (wait <= 300) as completed, count(*) filter (wait > 300) as failed,
        sum(wait::decimal(18,6))::double / count(wait) as mean_wait_of_started_s, max(wait) as max_wait_s, count(*) filter (wait is null) = 0 as idle from o group by 1""", "operations")),
    "run_report": (run_totals, oracle("""
      select project, count(*) as runs, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, count(*) filter (build_passed) as builds_passed,
        count(*) filter (not build_passed) as builds_failed, count(*) filter (build_passed is null) as builds_skipped, count(*) filter (passed) / count(*) * 100.0::double as pass_rate from runs group by 1""", "runs")),
    "threshold_exceedances": (exceeded, oracle("""
      , m as (select run_id, case run_id % 2 when 0 then 'prune_planning' else 'directory_move_convert' end as metric, case run_id % 2 when 0 then '500' else 'default' end as tier, operation_ms % 600 as ms from runs)
      select *, 300::bigint as limit_ms from m where ms > 300""", "runs")),
    "exceedances_by_table": (exceeded_by_table, oracle("""
      , m as (select op_id, op_type as metric, priority::varchar as tier, wait_s as ms from operations),
      l as (select metric, tier, floor(max(ms) / 2)::bigint as limit_ms from m group by 1, 2)
      select m.*, limit_ms from m join l using (metric, tier) where ms > limit_ms""", "operations")),
    "regressions": (regressed, f"""{DIAG}, c as (select code, message, count(*) filter (side = 1) - count(*) filter (side = 0) as surplus from d group by 1, 2) select * from c where surplus > 0"""),
    "regression_gate": (gated, f"""{DIAG} select count(*) filter (side = 0) as baseline, count(*) filter (side = 1) as current, count(*) filter (side = 1) > count(*) filter (side = 0) as failed from d"""),
    "snapshot_diff": (diffed, oracle("""select path, case length(content) % 10 when 1 then 'added' when 2 then 'removed' when 3 then 'modified' else 'unchanged' end as state from files""", "files")),
    "incremental_reindex": (reindexed, oracle("""
      , n as (select count(*) as c from supplier), live as (select path, regexp_extract(path, '/s([0-9]+)[.]', 1)::bigint as s from import_corpus),
      raw as (select path, (s * 7 + 3) % c + 1 as t from live, n union all select path, (s * 11 + 5) % c + 1 from live, n where not regexp_matches(path, '^src/m[0369]/') and (s * 11 + 5) % c + 1 <> s)
      select distinct raw.path as src, live.path as dst from raw join live on live.s = raw.t""", "import_corpus")),
    "stored_edges": (stored_edges, oracle("""
      , n as (select count(*) as c from supplier), live as (select path, regexp_extract(path, '/s([0-9]+)[.]', 1)::bigint as s from import_corpus),
      raw as (select path, (s * 7 + 3) % c + 1 as t from live, n where s % 4 <> 1
        union all select path, (s * 11 + 5) % c + 1 from live, n where s % 4 <> 1 and not regexp_matches(path, '^src/m[069]/') and (s * 11 + 5) % c + 1 <> s)
      select distinct raw.path as src, live.path as dst from raw join live on live.s = raw.t where live.s % 4 <> 1""", "import_corpus")),
    "expired": (stale_entries, oracle("select request_id from requests where ts < timestamp '2024-01-20 11:00:00'", "requests")),
    "progress_state": (tasks, oracle("""
      , r as (select *, row_number() over (partition by token order by ts, event_id) as i from progress),
      walk as (select token, 0::bigint as i, null::varchar as state, null::varchar as title, null::varchar as message from (select distinct token from progress)
        union all select r.token, r.i, case r.kind when 'begin' then 'in_progress' when 'end' then 'completed' else coalesce(w.state, 'in_progress') end,
          case r.kind when 'begin' then r.title when 'end' then null else case when w.state is null then 'Unknown' else w.title end end,
          case when r.kind = 'report' and w.state = 'completed' then w.message else r.message end
        from walk w join r on r.token = w.token and r.i = w.i + 1)
      select token, state, title, message, i as events from walk w where i = (select count(*) from progress p where p.token = w.token)""", "progress", recursive=True)),
    "stalled_tasks": (stalled, oracle("""
      select token, event_id as begin_id, title, 'failed' as state, 'timeout' as reason from progress b where kind = 'begin'
        and not exists (select 1 from progress e where e.kind = 'end' and e.token = b.token and e.ts between b.ts and b.ts + interval 12 hour)""", "progress")),
    "progress_percentages": (percentages, oracle("""
      , e as (select token, max(struct_pack(t := ts, i := event_id)) as last, max(case when kind in ('begin', 'end') then struct_pack(t := ts, i := event_id) end) as edge from progress group by token),
      t as (select e.token, coalesce(p.kind = 'end', false) as done, e.last.i % 101 as share from e left join progress p on p.token = e.token and p.event_id = e.edge.i)
      select case when done then 'completed' else 'in_progress' end as state, case when not done then share end::int as percentage, count(*) as tasks, min(token) as first from t group by 1, 2""", "progress")),
    "task_alerts": (alerts, oracle("""
      , l as (select unnest([{'level': 'warning', 'reason': 'slow', 'hours': 1}, {'level': 'failed', 'reason': 'timeout', 'hours': 12}]) as x)
      select token, event_id as begin_id, title, x.level as level, x.reason as reason, epoch_us(ts) + x.hours * 3600000000 as at_us from progress b, l where kind = 'begin'
        and not exists (select 1 from progress e where e.kind = 'end' and e.token = b.token and epoch_us(e.ts) between epoch_us(b.ts) and epoch_us(b.ts) + x.hours * 3600000000)""", "progress")),
    "pair_requests": (paired, """with e as (select event_id as request_id, event_type, round(value * 2000000)::bigint as us from events)
      select request_id, case when event_type <> 'view' and us <= 60000000 then 'answered' else 'timeout' end as status,
        case when event_type <> 'view' and us <= 60000000 then us / 1000.0::double end as ms from e"""),
    "windowed_metrics": (windows, oracle(f"""select epoch_us(date_trunc('hour', ts)) as window_us, plugin, count(*) as requests, count(*) filter (ok) as ok, {MEAN} as mean_ms, max(ms) as max_ms from requests group by 1, 2""", "requests")),
    "sliding_metrics": (sliding, oracle("""
      , s as (select epoch_us(date_trunc('hour', ts)) - o * 3600000000 as window_us, plugin, ok from requests, (select unnest([0, 1]) as o))
      select window_us, plugin, count(*) as requests, count(*) filter (ok) as ok from s group by 1, 2""", "requests")),
    "throttled_changes": (throttled, oracle("""select epoch_us(created_at) // 7200000000 * 7200000000 as refresh_us, op_type as project, path, count(*) as changes from operations group by 1, 2, 3""", "operations")),
    "batched_writes": (write_units, oracle(f"{SESSIONS} select op_id, path, unit, row_number() over (partition by path, unit order by created_at, op_id) as position from u", "operations")),
    "batched_write_units": (write_sessions, oracle(f"""{SESSIONS} select path, min(epoch_us(created_at)) as start_us, max(epoch_us(created_at)) + 3600000000 as end_us, count(*) as operations,
        arg_min(op_id, (created_at, op_id)) as first_op, arg_max(op_id, (created_at, op_id)) as last_op from u group by path, unit""", "operations")),
}
