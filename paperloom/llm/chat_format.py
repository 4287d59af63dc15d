"""Chat formatting with tool-call linking, in built-in functions only.

An assistant turn may carry calls: a JSON object with `tool_calls`, each of `id`,
`name`, `arguments` (an object) and optionally `after` (ids of calls it needs).
Its `content` and other fields stay, the others below `other`.
A turn of role `tool` answers one: a JSON object with `tool_call_id` and
`content`. Calls and results meet in a hash join on conversation and identifier,
arguments are validated against the tools' schemas, calls are put in topological
order (level by level along `after`), and each turn becomes one canonical JSON
object: keys in order, no white space, null fields left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.workspace import Workspace

#: Tool, argument, kind, required.
SCHEMAS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("lookup", "table", "string", True),
    ("lookup", "row", "integer", True),
    ("calculate", "expression", "string", True),
    ("calculate", "precise", "boolean", False),
]
#: How a variant's type shows for each kind.
_KINDS = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY"}
_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"


def _levels(ws: Workspace, calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without needs, else one more than the highest need; null on a cycle.

    Each round settles the calls whose needs are all settled, so there are as many
    rounds as the longest chain. Needs that are not calls of the conversation don't count.
    """
    ids = calls.select("conv_id", "call_id").distinct()
    needs = calls.select("conv_id", "call_id", F.explode("after").alias("need")).distinct()
    needs = ws.save(needs.join(ids.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi"), "needs")
    done = ws.save(ids.join(needs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "level_0")
    step = 0
    while True:
        open_ = needs.join(done.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        met = open_.join(done.select("conv_id", F.col("call_id").alias("need"), "level"), ["conv_id", "need"], "left")
        ready = met.groupBy("conv_id", "call_id").agg(F.count_if(F.col("level").isNull()).alias("missing"), F.max("level").alias("top")).where("missing = 0").select("conv_id", "call_id", (F.col("top") + 1).alias("level"))
        step += 1
        ready = ws.save(ready, f"ready_{step}")
        if not ready.limit(1).count():
            return done
        done = ws.save(done.unionByName(ready), f"level_{step}")


def chat_format(spark: SparkSession, turns: DataFrame, schemas=None) -> DataFrame:
    """(conv_id, turn, role, n_calls, n_answered, n_invalid, orphan, json) for every row of turns(conv_id, turn, role, text).

    n_calls of the turn, how many of them have a result, how many break their
    schema (unknown tool, missing or wrongly typed argument, arguments that are no
    object); orphan marks a result without a call. Calls on a cycle come last, in
    the order they are written. The first call of an id counts, and of several
    results for a call the earliest. A turn with calls keeps its content, and its
    other fields below `other`, but for null ones. Text that is no such JSON is content as it
    stands. Null conversations link nothing. Other columns are not read.
    """
    ws = Workspace(spark, "chat-format")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("turn", "role", "text"))
    jsonlike = F.coalesce(F.col("text").rlike(r"^\s*\{"), F.lit(False))
    parsed = rows.where(jsonlike & (F.col("role") == "assistant") & F.col("text").contains("tool_calls")).distinct()
    calls = parsed.select("conv_id", "turn", "h", F.posexplode(F.from_json("text", _CALLS)["tool_calls"]).alias("place", "call"))
    calls = calls.select("conv_id", "turn", "h", "place", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.try_parse_json("call.arguments").alias("arguments"), F.coalesce("call.after", F.array().cast("array<string>")).alias("after"))
    first = Window.partitionBy("conv_id", "call_id").orderBy("turn", "place", "h")
    calls = ws.save(calls.withColumn("again", F.row_number().over(first) > 1), "calls")
    linked = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL AND NOT again")

    answer = F.from_json("text", "struct<tool_call_id:string,content:string>")
    results = rows.where(jsonlike & (F.col("role") == "tool")).select("conv_id", "turn", "h", answer["tool_call_id"].alias("call_id"), answer["content"].alias("result")).where("call_id IS NOT NULL").distinct()
    results = ws.save(results, "results")
    earliest = Window.partitionBy("conv_id", "call_id").orderBy("turn", "h")
    chosen = results.withColumn("r", F.row_number().over(earliest)).where("r = 1").select("conv_id", "call_id", "result", F.lit(True).alias("answered"))
    orphans = results.join(linked.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select("conv_id", "h").distinct().withColumn("orphan", F.lit(True))

    rules = spark.createDataFrame(list(schemas if schemas is not None else SCHEMAS), "name string, argument string, kind string, required boolean")
    rules = rules.groupBy("name").agg(F.collect_list(F.struct("argument", "kind", "required")).alias("rules"))
    typed = F.schema_of_variant(F.try_variant_get("arguments", F.concat(F.lit("$['"), "rule.argument", F.lit("']")), "variant"))
    kinds = F.create_map(*(F.lit(x) for kind, shown in _KINDS.items() for x in (kind, shown)))
    fits = F.coalesce(kinds[F.col("rule.kind")], F.lit("."))
    checked = calls.select("conv_id", "h", "place", "name", "arguments").join(rules, "name").select("conv_id", "h", "place", "arguments", F.explode("rules").alias("rule"))
    broken = checked.select("conv_id", "h", "place", F.when(F.coalesce(typed, F.lit("VOID")) == "VOID", F.col("rule.required")).otherwise(~F.regexp_like(typed, fits)).alias("bad")).groupBy("conv_id", "h", "place").agg(F.max("bad").alias("bad"))

    levels = _levels(ws, linked)
    full = (
        calls.join(chosen, ["conv_id", "call_id"], "left")
        .join(levels, ["conv_id", "call_id"], "left")
        .join(broken, ["conv_id", "h", "place"], "left")
        .withColumn("answered", F.coalesce(F.col("answered") & ~F.col("again"), F.lit(False)))
        .withColumn("valid", F.coalesce(~F.col("bad"), F.lit(False)) & F.coalesce(F.schema_of_variant("arguments").startswith("OBJECT"), F.lit(False)))
    )
    one = F.struct(F.coalesce("level", F.lit(2**30)).alias("level"), F.col("place"), F.to_json(F.struct(F.to_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name", F.when(F.col("answered"), F.col("result")).alias("result"), "valid")).alias("json"))
    grouped = full.groupBy(F.col("conv_id").alias("c"), F.col("h").alias("ch")).agg(
        F.array_sort(F.collect_list(one)).alias("sorted"), F.count("*").alias("n_calls"), F.count_if("answered").alias("n_answered"), F.count_if(~F.col("valid")).alias("n_invalid")
    )
    out = rows.join(grouped, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("ch")), "left").join(orphans.select(F.col("conv_id").alias("oc"), F.col("h").alias("oh"), "orphan"), F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("h") == F.col("oh")), "left")
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role", "turn"))
    fields, spelled = (F.when(F.col("sorted").isNotNull(), F.from_json("text", f"map<string,{kind}>")) for kind in ("variant", "string"))
    # a value with a key twice is no variant: then all are taken as they are spelled
    said = lambda k: F.coalesce(F.when(~F.is_variant_null(fields[k]), fields[k]), spelled[k].cast("variant"))
    names = F.filter(F.array_sort(F.array_distinct(F.map_keys(spelled))), lambda k: ~k.isin("tool_calls", "content") & said(k).isNotNull())
    other = F.when(F.size(names) > 0, F.map_from_entries(F.transform(names, lambda k: F.struct(k, said(k)))))
    beside = F.to_json(F.struct(said("content").alias("content"), other.alias("other"), "role", "turn"))
    head = F.concat(F.lit('{"calls":['), F.array_join(F.transform("sorted", lambda s: s["json"]), ","), F.lit("],"), F.substring(beside, 2, 2**31 - 1))
    return out.select(
        "conv_id", "turn", "role", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_calls", "n_answered", "n_invalid")), F.coalesce("orphan", F.lit(False)).alias("orphan"),
        F.when(F.col("sorted").isNull(), plain).otherwise(head).alias("json"),
    )
