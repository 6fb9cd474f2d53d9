"""Tool-call transcripts in DataFrame operations: calls joined with results by identifier, ordered by their
dependencies, arguments validated against schemas, and each call written as canonical JSON.

* Linking is a hash join on (conversation, id); results are reduced to the first of each id before it.
* Order: calls without open dependencies have level 0, others one more than the highest they wait for. A call's level is
  the greatest of terms "level of a call, plus so many". Terms on calls that are settled become numbers, terms on one call
  are merged, and calls with a single open term drop out: chains of them are jumped by pointers that double. So chains,
  diamonds and whatever is made of them in series and side by side take rounds as the logarithm of their length; what is
  not takes at most a round for each level. A call's position in its conversation is a count by level and turn, summed by
  blocks, so a conversation of any length is never gathered. Calls in or behind a cycle have no level and no position.
* Validation: a schema gives each parameter's JSON type, whether it is required, and, at any depth, values, bounds,
  lengths, properties and items; nothing else may occur unless it says so.
* Canonical JSON: keys sorted at every depth, no blanks, numbers in shortest form.

Defined cases: null or unparsable arguments, and arguments that are no object, are the error "arguments"; an unknown
tool is the error "name"; a call without a result has result null and linked false; a result without a call is left
out; calls that repeat an id each keep their row and share the result, and wait for what any of them waits for; ties in
level and turn go by id; dependencies on ids that no call has are the error "after:ID" and wait for nothing; a null id or
conversation links with nothing; very long arguments and results are carried whole; columns other than those named are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteweave.llm import common

#: Turns and levels of one block when positions are counted.
BLOCK = 1000
#: Kinds of JSON values as variant schemas begin.
KINDS = {"string": "STRING", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT", "null": "VOID"}
NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


@dataclass(frozen=True)
class Value:
    """What a JSON value must be. ``kind``: string, integer, number, boolean, array, object, null, or None for any."""

    kind: str | None = None
    required: bool = False
    enum: tuple = ()
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    properties: dict[str, Value] | None = None
    items: Value | None = None
    open: bool = False  # other properties may occur


def _fits(value: Column, kind: str) -> Column:
    of = F.schema_of_variant(value)
    if kind in KINDS:
        return of.startswith(KINDS[kind])
    number = F.try_variant_get(value, "$", "double")
    return of.rlike(NUMBERS) & (F.lit(True) if kind == "number" else F.coalesce(number == F.rint(number), F.lit(False)))


def _faults(value: Column, rule: Value, at: Column) -> Column:
    """Codes of what is wrong with a variant that is there, each behind its path."""
    none = F.array().cast("array<string>")
    if rule.kind is None:
        return none
    wrong, deeper = [], none
    code = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.concat(at, F.lit(f":{name}")))
    if rule.enum:
        wrong.append(code(~F.to_json(value).isin([json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for v in rule.enum]), "enum"))
    number, length = F.try_variant_get(value, "$", "double"), F.length(F.try_variant_get(value, "$", "string"))
    if rule.kind == "array":
        length = F.size(F.try_variant_get(value, "$", "array<variant>"))
    wrong += [code(test, name) for limit, test, name in ((rule.minimum, number < F.lit(rule.minimum), "range"), (rule.maximum, number > F.lit(rule.maximum), "range"), (rule.min_length, length < F.lit(rule.min_length), "length"), (rule.max_length, length > F.lit(rule.max_length), "length")) if limit is not None]
    if rule.kind == "object" and rule.properties is not None:
        deeper = _properties(value, rule, F.concat(at, F.lit(".")))
    if rule.kind == "array" and rule.items is not None:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v, i: _faults(v, rule.items, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        deeper = F.coalesce(F.flatten(each), none)
    inside = F.concat(F.array_compact(F.array(*wrong)), deeper) if wrong else deeper
    return F.when(_fits(value, rule.kind), inside).otherwise(F.array(F.concat(at, F.lit(":type"))))


def _properties(value: Column, rule: Value, at: Column) -> Column:
    """Codes of what is wrong with an object's properties."""
    none = F.array().cast("array<string>")
    have = F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    found = []
    for name, inner in rule.properties.items():
        got, place = F.try_element_at(have, F.lit(name)), F.concat(at, F.lit(name))
        absent = F.array(F.concat(place, F.lit(":missing"))) if inner.required else none
        found.append(F.when(F.map_contains_key(have, name), _faults(got, inner, place)).otherwise(absent))
    if not rule.open:
        known = F.array(*map(F.lit, rule.properties)).cast("array<string>")
        found.append(F.transform(F.array_except(F.map_keys(have), known), lambda k: F.concat(at, k, F.lit(":unknown"))))
    return F.concat(*found) if found else none


def _rule(fields: dict[str, tuple[str, bool] | Value]) -> Value:
    return Value("object", properties={k: v if isinstance(v, Value) else Value(v[0], v[1]) for k, v in fields.items()})


def validate(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool] | Value]]) -> Column:
    """Sorted array of error codes for JSON ``arguments`` of tool ``name``; schemas: {tool: {parameter: (type, required), or
    a ``Value``}}."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    found = None
    for tool, fields in schemas.items():
        errors = F.array_sort(F.array_distinct(_properties(parsed, _rule(fields), F.lit(""))))
        found = F.when(name == tool, errors) if found is None else found.when(name == tool, errors)
    errors = F.array(F.lit("name")) if found is None else found.otherwise(F.array(F.lit("name")))
    return F.when(is_object, errors).otherwise(F.array(F.lit("arguments")))


def _met(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A hash join: ``few`` has one narrow row for each key."""
    return rows.join(few.hint("shuffle_hash"), keys, how)


def _jumped(single: DataFrame) -> DataFrame:
    """``single`` (conv, id, anchor, dist, base): calls whose level is the greater of base and the anchor's level plus dist;
    with anchors that are none of them. Those that lead into a cycle of them are left out."""
    jumps = common.materialise(single.withColumn("moving", F.lit(True)), "jumps")
    moving, first = jumps.count(), True
    while moving:
        on = jumps.select("conv", F.col("id").alias("anchor"), F.col("anchor").alias("_to"), F.col("dist").alias("_more"), F.col("base").alias("_base"))
        step = _met(jumps, on, ["conv", "anchor"], "left")
        base = F.greatest("base", F.coalesce(F.col("_base") + F.col("dist"), F.lit(0)))
        step = step.select("conv", "id", F.coalesce("_to", "anchor").alias("anchor"), (F.col("dist") + F.coalesce("_more", F.lit(0))).alias("dist"), base.alias("base"), F.col("_to").isNotNull().alias("moving"))
        old, jumps = jumps, common.materialise(step, "jumps")
        common.discard(old)
        left = jumps.filter("moving").count()
        if left == moving and not first:
            break  # distances double: a round in which none stops has only cycles left
        moving, first = left, False
    return jumps.filter(~F.col("moving")).drop("moving")


def levels(ids: DataFrame, waits: DataFrame) -> DataFrame:
    """(conv, id, level) of the calls ``ids`` (conv, id), by what they wait for (conv, id, dep: among ids, each once); those
    in or behind a cycle are left out."""
    known = ids.join(waits.select("conv", "id").distinct(), ["conv", "id"], "left_anti").withColumn("level", F.lit(0))
    known = common.materialise(known, "levels")
    # a call's level is the greatest of its terms: the anchor's level plus dist, or dist where there is no anchor
    terms = waits.select("conv", "id", F.col("dep").alias("anchor"), F.lit(1).alias("dist"))
    out: list[DataFrame] = []
    settled, gone = known, None
    while True:
        at = _met(terms, settled.select("conv", F.col("id").alias("anchor"), F.col("level").alias("_level")), ["conv", "anchor"], "left")
        at = at.select("conv", "id", F.when(F.col("_level").isNull(), F.col("anchor")).alias("anchor"), (F.col("dist") + F.coalesce("_level", F.lit(0))).alias("dist"))
        if gone is not None:
            past = _met(at, gone.select("conv", F.col("id").alias("anchor"), F.col("anchor").alias("_to"), F.col("dist").alias("_more"), F.col("base").alias("_base")), ["conv", "anchor"], "left")
            through = F.struct(F.coalesce("_to", "anchor").alias("anchor"), (F.col("dist") + F.coalesce("_more", F.lit(0))).alias("dist"))
            least = F.struct(F.lit(None).cast("string").alias("anchor"), (F.col("dist") + F.coalesce("_base", F.lit(0))).alias("dist"))
            at = past.select("conv", "id", F.inline(F.when(F.col("_to").isNull(), F.array(through)).otherwise(F.array(through, least))))
        merged = common.materialise(at.groupBy("conv", "id", "anchor").agg(F.max("dist").alias("dist")), "terms")
        one = merged.groupBy("conv", "id").agg(F.count("anchor").alias("n"), F.min("anchor").alias("anchor"), F.max(F.when(F.col("anchor").isNotNull(), F.col("dist"))).alias("dist"), F.coalesce(F.max(F.when(F.col("anchor").isNull(), F.col("dist"))), F.lit(0)).alias("base"))
        one = common.materialise(one, "calls-open")
        settled = one.filter("n = 0").select("conv", "id", F.col("base").alias("level"))
        known = common.materialise(known.unionByName(settled), "levels")
        gone = _jumped(one.filter("n = 1").select("conv", "id", "anchor", "dist", "base"))
        out.append(gone)
        terms = merged.join(one.filter("n > 1").select("conv", "id"), ["conv", "id"], "left_semi")
        if terms.isEmpty() or one.filter("n <= 1").isEmpty():
            break
        settled = known
    for part in reversed(out):  # what a chain hangs on has been settled, or went later than it
        met = _met(part, known.select("conv", F.col("id").alias("anchor"), "level"), ["conv", "anchor"])
        known = common.materialise(known.unionByName(met.select("conv", "id", F.greatest("base", F.col("level") + F.col("dist")).alias("level"))), "levels")
    return known


def positions(placed: DataFrame) -> DataFrame:
    """``placed`` (conv, turn, id, level, ...) with position: its rank in the conversation by level, turn and id."""
    placed = placed.withColumn("high", F.floor(F.col("level") / BLOCK)).withColumn("low", F.floor(F.col("turn") / BLOCK))
    counts = placed.groupBy("conv", "high", "level", "low").agg(F.count(F.lit(1)).alias("n"))

    def before(keys: list[str], order: list[str]) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    high = counts.groupBy("conv", "high").agg(F.sum("n").alias("n")).select("conv", "high", before(["conv"], ["high"]).alias("first"))
    low = counts.select("conv", "high", "level", "low", before(["conv", "high"], ["level", "low"]).alias("second"))
    row = F.row_number().over(Window.partitionBy("conv", "high", "level", "low").orderBy("turn", "id"))
    ranked = placed.withColumn("third", row).join(low, ["conv", "high", "level", "low"]).join(high, ["conv", "high"])
    return ranked.withColumn("position", (F.col("first") + F.col("second") + F.col("third") - 1).cast("long")).drop("high", "low", "first", "second", "third")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool] | Value]]) -> DataFrame:
    """Calls (conv, turn, id, name, arguments, after) with results (conv, turn, id, content): one row for each call, with
    level, position, linked, valid, errors and json."""
    first = results.groupBy("conv", "id").agg(F.min_by("content", F.struct("turn", F.coalesce("content", F.lit("")))).alias("content"), F.lit(True).alias("linked"))
    number = F.monotonically_increasing_id()
    calls = common.materialise(calls.select("conv", "turn", "id", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after")).withColumn("row", number), "calls")
    ids = common.materialise(calls.select("conv", "id").filter(F.col("conv").isNotNull() & F.col("id").isNotNull()).distinct(), "call-ids")
    asked = calls.select("conv", "id", "row", F.explode(F.array_distinct("after")).alias("dep"))
    asked = common.materialise(_met(asked, ids.select("conv", F.col("id").alias("dep"), F.lit(True).alias("found")), ["conv", "dep"], "left"), "waits")
    waits = asked.filter("found").select("conv", "id", "dep").filter(F.col("id").isNotNull()).distinct()
    lost = asked.filter("found IS NULL AND dep IS NOT NULL").groupBy("row").agg(F.array_sort(F.transform(F.collect_set("dep"), lambda d: F.concat(F.lit("after:"), d))).alias("lost"))  # of one call
    placed = common.materialise(_met(calls.select("conv", "turn", "id", "row"), levels(ids, waits), ["conv", "id"], "left"), "placed")
    ranked = positions(placed.filter("level IS NOT NULL")).select("row", "level", "position")
    rows = _met(calls, ranked, ["row"], "left")
    rows = _met(_met(rows, lost, ["row"], "left"), first, ["conv", "id"], "left")
    errors = F.concat(validate(F.col("name"), F.col("arguments"), schemas), F.coalesce("lost", F.array().cast("array<string>")))
    rows = rows.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0).withColumn("linked", F.coalesce("linked", F.lit(False)))
    record = F.struct(F.try_parse_json("arguments").alias("arguments"), "id", "name", F.col("content").alias("result"))
    return rows.select("conv", "turn", "id", "name", "level", "position", "linked", "valid", "errors", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def transcript(linked: DataFrame) -> DataFrame:
    """One row for each linked, valid call, range-sorted by conversation and position."""
    return linked.filter("linked AND valid").select("conv", "position", "json").orderBy("conv", "position")


#: The tools that the conversations' replies stand for.
SCHEMAS = {"open": {"text": ("string", True), "n": ("integer", False)}, "reply": {"text": ("string", True), "n": ("integer", True)}}


def from_conversations(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of messages: an assistant's turn is a call (its first is "open", later ones
    "reply", after the reply two turns before), and the user's turn behind it is its result. Some conversations, by
    number, break the schemas."""
    conv, turn = F.col("conv_id"), F.col("turn")
    name = F.when(turn < 2, "open").otherwise("reply")
    n = F.size(F.split("text", " ")).cast("long")
    fields = F.struct(
        F.when(conv % 13 != 0, F.col("text")).alias("text"),
        F.when(conv % 11 == 0, F.lit(None).cast("long")).otherwise(n).alias("n"),
        F.when(conv % 17 == 0, F.lit(True)).alias("x"),
    )
    ident = lambda t: F.concat(F.lit("c"), conv.cast("string"), F.lit("-"), t.cast("string"))
    after = F.when(turn >= 2, F.array(ident(turn - 2))).otherwise(F.array().cast("array<string>"))
    calls = messages.filter(F.col("role") == "assistant").select(conv.alias("conv"), turn.alias("turn"), ident(turn).alias("id"), name.alias("name"), F.to_json(fields).alias("arguments"), after.alias("after"))
    results = messages.filter(F.col("role") == "user").select(conv.alias("conv"), turn.alias("turn"), ident(turn - 1).alias("id"), F.col("text").alias("content"))
    return calls, results


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_conversations(common.table(spark, sf_dir, "conversations"))
    done = link(calls, results, SCHEMAS)
    return done.select(F.col("conv").alias("conv_id"), "turn", F.col("id").alias("call_id"), "name", "level", "position", "linked", "valid", F.array_join("errors", ",").alias("errors"), "json")


OP6_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, CASE WHEN turn < 2 THEN 'open' ELSE 'reply' END AS name, text, len(string_split(text, ' ')) AS n
  FROM conversations WHERE role = 'assistant'),
lv AS (
  SELECT c.conv_id, c.turn, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, lv.level + 1 FROM lv JOIN calls c ON c.conv_id = lv.conv_id AND c.turn = lv.turn + 2),
res AS (SELECT conv_id, turn - 1 AS turn, text AS content FROM conversations WHERE role = 'user'),
rows_ AS (
  SELECT c.*, lv.level, r.content, r.conv_id IS NOT NULL AS linked,
    concat_ws(',', CASE WHEN c.conv_id % 11 = 0 AND c.name = 'reply' THEN 'n:missing' END, CASE WHEN c.conv_id % 13 = 0 THEN 'text:missing' END,
      CASE WHEN c.conv_id % 17 = 0 THEN 'x:unknown' END,
      CASE WHEN c.turn >= 2 AND NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 2) THEN 'after:c' || c.conv_id || '-' || (c.turn - 2) END) AS errors
  FROM calls c JOIN lv ON lv.conv_id = c.conv_id AND lv.turn = c.turn LEFT JOIN res r ON r.conv_id = c.conv_id AND r.turn = c.turn)
SELECT conv_id, turn, call_id, name, level::INTEGER AS level, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn) - 1 AS position, linked, errors = '' AS valid, errors,
  '{"arguments":{' || concat_ws(',', CASE WHEN conv_id % 11 <> 0 THEN '"n":' || n END, CASE WHEN conv_id % 13 <> 0 THEN '"text":' || to_json(text)::VARCHAR END, CASE WHEN conv_id % 17 = 0 THEN '"x":true' END)
    || '},"id":' || to_json(call_id)::VARCHAR || ',"name":' || to_json(name)::VARCHAR || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM rows_
"""
