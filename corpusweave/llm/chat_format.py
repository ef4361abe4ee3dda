"""Tool-call linking: calls joined with results by identifier, ordered by their dependencies, checked and written as canonical JSON.

DataFrame expressions only. One row is one call or one unmatched result: no conversation is collected, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.storage import small, written

SCHEMA_ROWS = 100_000  # schema tables up to this many rows are broadcast


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level: 0 without (known) dependencies, else one more than the highest of them; calls on a cycle are missing.

    Ordering a conversation by (level, seq) puts every call after those it depends on. Each round
    settles the calls whose dependencies are all settled, so rounds number as many as the longest chain of dependencies.
    """
    ids = calls.select("call_id").distinct()
    edges = calls.select("call_id", F.explode(F.array_distinct("depends_on")).alias("on")).distinct()
    edges = written(edges.join(ids.select(F.col("call_id").alias("on")), "on").select("call_id", "on"), "dependencies")
    needs = edges.groupBy("call_id").agg(F.count("*").alias("needed"))
    latest = written(ids.join(needs, "call_id", "left_anti").select("call_id", F.lit(0).alias("level")), "levels")
    done, met = latest, None
    while not latest.isEmpty():
        found = edges.join(latest.select(F.col("call_id").alias("on"), "level"), "on").select("call_id", "level")
        step = found.groupBy("call_id").agg(F.count("*").alias("n"), F.max("level").alias("level"))
        if met is not None:
            step = step.union(met).groupBy("call_id").agg(F.sum("n").alias("n"), F.max("level").alias("level"))
        step = written(step.join(needs, "call_id").withColumn("ready", F.col("n") == F.col("needed")), "settling")
        met = step.filter("not ready").select("call_id", "n", "level")
        latest = step.filter("ready").select("call_id", (F.col("level") + 1).alias("level"))
        done = done.union(latest)
    return done


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """`calls` with canonical arguments and errors.

    `schemas` has one row per tool and field: name, field, type (string, integer, number, boolean), required, least, most (bounds
    of a number's value or a string's length; null: none). Errors: unknown_tool, bad_json (not an object, or a key twice),
    and missing, type, range and unknown with the field's name. Keys of canonical arguments are sorted at every depth.
    """
    fields = F.struct("field", "type", "required", "least", "most")
    tools = small(schemas.groupBy("name").agg(F.sort_array(F.collect_set(fields)).alias("fields")), SCHEMA_ROWS)
    parsed = calls.withColumn("v", F.try_parse_json("arguments"))
    parsed = parsed.withColumn("given", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.from_json("arguments", "map<string,variant>")))

    def judged(f):
        value = F.element_at("given", f["field"])
        kind = F.schema_of_variant(value)
        wanted = {"string": kind == "STRING", "integer": kind == "BIGINT", "boolean": kind == "BOOLEAN",
                  "number": kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")}
        right = F.coalesce(*(F.when(f["type"] == name, test) for name, test in wanted.items()), F.lit(False))
        size = F.when(kind == "STRING", F.char_length(F.try_variant_get(value, "$", "string")).cast("double")).otherwise(F.try_variant_get(value, "$", "double"))
        absent = value.isNull() | (kind == "VOID")
        return (F.when(absent & f["required"], F.concat(F.lit("missing:"), f["field"])).when(absent, F.lit(None))
                .when(~right, F.concat(F.lit("type:"), f["field"]))
                .when((size < f["least"]) | (size > f["most"]), F.concat(F.lit("range:"), f["field"])))

    joined = parsed.join(tools, "name", "left")
    unknown = F.transform(F.array_except(F.map_keys("given"), F.transform("fields", lambda f: f["field"])), lambda k: F.concat(F.lit("unknown:"), k))
    errors = (F.when(F.col("fields").isNull(), F.array(F.lit("unknown_tool"))).when(F.col("given").isNull(), F.array(F.lit("bad_json")))
              .otherwise(F.array_sort(F.concat(F.array_compact(F.transform("fields", judged)), unknown))))
    return joined.withColumn("errors", errors).withColumn("canonical", F.to_json("v")).drop("v", "given", "fields")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, seq, level, status, errors, message for every call, and for every result without a call.

    calls: conv_id, call_id, seq, name, arguments, depends_on; results: conv_id, call_id, content. Identifiers are compared
    across the whole table. status: answered, unanswered, orphan (a result without a call), repeated (an identifier with
    several calls or results: each pair is a row), cycle (dependencies that never settle; level is
    null). Calls and results without identifier stay unanswered and orphan. Dependencies on unknown calls
    are ignored. Equal rows are one row. message is JSON with sorted keys and no blanks; absent parts are left out.
    Empty tables give no rows; further columns are ignored.
    """
    calls = calls.select("conv_id", "call_id", "seq", "name", "arguments", "depends_on").distinct()
    results = results.select(F.col("conv_id").alias("result_conv"), F.col("call_id").alias("result_id"), "content").distinct()
    order = levels(calls.filter("call_id is not null"))
    checked = argument_errors(calls, schemas).join(order, "call_id", "left")
    many = calls.groupBy("call_id").count().union(results.groupBy("result_id").count()).filter("count > 1").select(F.col("call_id").alias("many_id")).distinct()
    # Marks say which side a row has: any of its data may be null.
    both = checked.withColumn("is_call", F.lit(True)).join(results.withColumn("is_result", F.lit(True)), F.col("call_id") == F.col("result_id"), "full")
    both = both.withColumn("id", F.coalesce("call_id", "result_id")).join(many, F.col("id") == F.col("many_id"), "left")
    orphan, no_result = F.col("is_call").isNull(), F.col("is_result").isNull()
    status = (F.when(orphan, "orphan").when(F.col("many_id").isNotNull(), "repeated").when(F.col("level").isNull() & F.col("call_id").isNotNull(), "cycle")
              .when(no_result, "unanswered").otherwise("answered"))
    part = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))
    text = lambda column: F.to_json(F.col(column).cast("variant"))
    message = F.concat(F.lit("{"), F.concat_ws(
        ",", part("arguments", F.col("canonical")), part("content", text("content")), part("id", text("id")),
        part("level", F.col("level").cast("string")), part("name", text("name")), part("status", text("status"))), F.lit("}"))
    none = F.array().cast("array<string>")
    return both.withColumn("status", status).select(
        F.coalesce("conv_id", "result_conv").alias("conv_id"), F.col("id").alias("call_id"), "seq", "level", "status",
        F.coalesce("errors", none).alias("errors"), message.alias("message"))


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas read out of plain conversations.

    An assistant's turn is a call, the user's turn after it is its result; the tool goes by the turn's number, its arguments are
    the text and the text's length, and it depends on the call half as many turns in. Turns of other roles (`system`) are
    neither call nor result, and are left out.
    """
    call_id = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    tool = F.element_at(F.array(F.lit("lookup"), F.lit("search"), F.lit("store")), (F.pmod("turn", F.lit(3)) + 1).cast("int"))
    calls = turns.filter("role = 'assistant'").select(
        "conv_id", call_id(F.col("turn")).alias("call_id"), F.col("turn").alias("seq"), tool.alias("name"),
        F.concat(F.lit('{"query": '), F.to_json(F.coalesce("text", F.lit("")).cast("variant")), F.lit(', "limit": '), F.char_length(F.coalesce("text", F.lit(""))).cast("string"), F.lit("}")).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(call_id(F.floor(F.col("turn") / 2)))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = turns.filter("role = 'user'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = turns.sparkSession.createDataFrame(
        [("lookup", "query", "string", True, 1.0, None), ("lookup", "limit", "integer", False, 1.0, 2000.0),
         ("search", "query", "string", True, 1.0, 1500.0), ("search", "limit", "number", True, None, None)],
        "name string, field string, type string, required boolean, least double, most double")
    return calls, results, schemas


def op9_tool_call_linking(spark, sf_dir: str) -> DataFrame:
    return link_tool_calls(*conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = """
with recursive t as (select distinct * from conversations),
c as (select distinct conv_id, 'c' || conv_id || '-' || turn as call_id, turn as seq, ['lookup', 'search', 'store'][turn % 3 + 1] as name,
             coalesce(text, '') as q, case when turn >= 2 then 'c' || conv_id || '-' || (turn // 2) end as dep from t where role = 'assistant'),
r as (select distinct conv_id as rc, 'c' || conv_id || '-' || (turn - 1) as rid, text as content from t where role = 'user'),
ids as (select distinct call_id from c),
e as (select distinct call_id, dep from c where dep in (select call_id from ids)),
lv as (select call_id, 0 as level from ids where call_id not in (select call_id from e)
       union all select e.call_id, lv.level + 1 from e join lv on e.dep = lv.call_id),
many as (select call_id as mid from c group by 1 having count(*) > 1 union select rid from r group by 1 having count(*) > 1),
j as (select c.*, rc, rid, content, lv.level, coalesce(c.call_id, rid) as id,
             case when c.call_id is null then 'orphan' when mid is not null then 'repeated' when rid is null then 'unanswered' else 'answered' end as status
      from c full join r on c.call_id = r.rid left join lv on lv.call_id = c.call_id left join many on mid = coalesce(c.call_id, rid))
select coalesce(conv_id, rc) as conv_id, id as call_id, seq, level, status,
       case when name is null then []::varchar[] when name = 'store' then ['unknown_tool']
            when name = 'lookup' then list_sort(list_filter([case when length(q) < 1 or length(q) > 2000 then 'range:limit' end,
                                              case when length(q) < 1 then 'range:query' end], lambda x: x is not null))
            else list_filter([case when length(q) < 1 or length(q) > 1500 then 'range:query' end], lambda x: x is not null) end as errors,
       '{' || concat_ws(',', case when name is not null then '"arguments":{"limit":' || length(q) || ',"query":' || to_json(q)::varchar || '}' end,
              case when content is not null then '"content":' || to_json(content)::varchar end, '"id":' || to_json(id)::varchar,
              case when level is not null then '"level":' || level end, case when name is not null then '"name":"' || name || '"' end,
              '"status":"' || status || '"') || '}' as message
from j
"""

QUERIES = {"op9_tool_call_linking": (op9_tool_call_linking, ORACLE)}
