"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, piecewise linear between knots. Its integral gives the
source's cumulative demand, scaled to its target; the target is the source's share of the budget by weight, stopped at
``most`` times its size with the excess reshared by weight. Documents of a source stand in a fixed shuffled order (hash
of id and text); a pass over the source lays them end to end, and the document that begins at demand v is trained at
the time when the source's cumulative demand reaches v. A pass's document is taken when its middle lies below the
target, so taken words miss the target by at most half a document. Documents are range-sorted by that time.

Sources are a table, whatever their number: their ranks, targets and schedules stay in it, and the driver sees sums
over it alone. Sizes are summed by (source, hash bucket) before prefix sums, and running sums stay within buckets; a
bucket that repeated rows overfill is split by the rows' order. Texts go through one word count, and, where they are
carried, through one join with the narrow rows that have been placed without them.

Defined cases: a null text has size 0; a very long text is one row like others; a null source is a source of its own,
last; a source without words has target 0 and nothing of it is taken; rows that share id and text are ordered as read
and each have a place; an empty table gives no rows; all columns of the input are kept unless they have the name of a
new one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteweave.llm import common

#: Rows of one hash bucket; one that has OVERFULL times as many is split.
BUCKET_ROWS, OVERFULL = 20_000, 8
#: Words are runs of anything but blanks and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
KNOTS = "array<struct<time:double,weight:double>>"
NEW = ("size", "source_size", "target", "taken", "positions")


def words_of(text: Column) -> Column:
    """Number of words of a text: places where a word begins."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(blank, F.lit("[^ ]+")).cast("long")


def targets(sizes: dict, weights: dict, budget: float, most: float) -> dict:
    """The definition that ``source_plan`` follows on tables: each source's share of ``budget`` by weight, at most
    ``most`` times its size, the excess reshared."""
    capped: dict = {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = budget - sum(capped.values())
        total = sum(weights[s] for s in free)
        share = {s: left * weights[s] / total for s in free} if total else {}
        over = [s for s in free if share.get(s, 0.0) > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(most * sizes[s]) for s in over}


def schedule(weight: Column, tilt: Column) -> Column:
    """Knots of a source whose weight moves from ``weight * (1 - tilt)`` to ``weight * (1 + tilt)``."""
    knots = [(0.0, weight * (1 - tilt)), (0.5, weight), (1.0, weight * (1 + tilt))]
    return F.array(*[F.struct(F.lit(t).alias("time"), w.cast("double").alias("weight")) for t, w in knots]).cast(KNOTS)


def _pieces(knots: Column) -> Column:
    """The linear pieces between knots: begin, weight there, slope, area, and the area of all before."""
    between = F.zip_with(F.slice(knots, F.lit(1), F.size(knots) - 1), F.slice(knots, F.lit(2), F.size(knots) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    between = F.filter(between, lambda p: p.b.time > p.a.time)
    plain = F.transform(between, lambda p: F.struct(p.a.time.alias("time"), p.a.weight.alias("weight"), ((p.b.weight - p.a.weight) / (p.b.time - p.a.time)).alias("slope"), ((p.b.time - p.a.time) * (p.a.weight + p.b.weight) / 2).alias("area")))
    return F.transform(plain, lambda p, i: F.struct(p.time.alias("time"), p.weight.alias("weight"), p.slope.alias("slope"), p.area.alias("area"), F.aggregate(F.slice(plain, F.lit(1), i), F.lit(0.0), lambda s, q: s + q.area).alias("before")))


def _time(pieces: Column, share: Column) -> Column:
    """The time by which the integral over the pieces has reached ``share`` (0 to 1) of its whole; of nothing, the time when
    it begins to grow."""
    last = F.element_at(pieces, -1)
    x = share * (last.before + last.area)
    piece = F.coalesce(F.get(F.filter(pieces, lambda p: (p.area > 0) & (x <= p.before + p.area)), 0), last)

    def within(p: Column) -> Column:
        rest = F.greatest(x - p.before, F.lit(0.0))  # of the demand, within this piece
        steep = (F.sqrt(F.greatest(p.weight * p.weight + 2 * p.slope * rest, F.lit(0.0))) - p.weight) / p.slope
        flat = F.when(p.weight > 0, rest / p.weight).otherwise(F.lit(0.0))
        return p.time + F.when(F.abs(p.slope) < 1e-12, flat).otherwise(steep)

    found = F.get(F.transform(F.array(piece), within), 0)  # so the piece is looked up once
    return F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0))


def _inverse(knots: list[tuple[float, float]], share: Column) -> Column:
    literal = F.array(*[F.struct(F.lit(float(t)).alias("time"), F.lit(float(w)).alias("weight")) for t, w in knots])
    return _time(_pieces(literal), share)


def source_plan(sums: DataFrame, cycle: tuple[float, ...], budget_share: float, most: float, schedules: DataFrame | None) -> DataFrame:
    """(source, number, source_size, target, pieces) of ``sums`` (source, source_size): sources numbered by code point,
    null last, weighted by ``cycle``, and filled to one level of words for each weight, at most ``most`` times their
    sizes. The level rises from round to round by the sums of the sources that have and have not reached their caps."""
    plan = common.numbered(sums, [F.col("source").isNull(), F.col("source")], "number")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    plan = plan.withColumn("weight", F.get(weights, F.pmod("number", F.lit(len(cycle))).cast("int"))).withColumn("cap", most * F.col("source_size").cast("double"))
    plan = common.materialise(plan, "mix-sources")
    r = plan.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget = budget_share * (r.size or 0)
    level = budget / r.weight if r.weight else 0.0
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        r = plan.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        rise = (budget - (r.full or 0.0)) / r.weight if r.weight else math.inf
        if not rise > level * (1 + 1e-15):
            break
        level = rise
        if level == math.inf:
            break
    target = F.col("cap") if level == math.inf else F.least(F.col("cap"), F.col("weight") * F.lit(level))
    knots = schedule(F.col("weight"), F.when(F.col("number") % 2 == 1, 0.5).otherwise(-0.5))
    if schedules is not None:
        own = schedules.select(F.col("source").cast("string").alias("_source"), F.col("knots").cast(KNOTS).alias("_knots"))
        plan = plan.join(own, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        knots = F.coalesce("_knots", knots)
    return plan.select("source", "number", "source_size", target.alias("target"), _pieces(knots).alias("pieces"))


def _place(rows: DataFrame, cycle: tuple[float, ...], budget_share: float, most: float, schedules: DataFrame | None) -> DataFrame:
    """``rows`` (source, size, hash, order, ...) with source_size, target, taken and positions."""
    key = ["_source", "_none"]  # a source as columns that compare nulls, too
    rows = rows.withColumns({"_source": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()})
    found = common.materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sums")
    n = found.agg(F.max("n").alias("n")).first().n or 1
    plan = source_plan(found.drop("n"), cycle, budget_share, most, schedules)
    plan = plan.withColumns({"_source": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()}).drop("source")
    # buckets of a source are its hash ranges, as many as the rows of the largest need
    bits = max(6, math.ceil(math.log2(max(1, n / BUCKET_ROWS))))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("hash", 64 - bits))
    full = rows.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > OVERFULL * BUCKET_ROWS)
    full = common.materialise(full.select(*key, "bucket", F.ceil(F.col("n") / BUCKET_ROWS).alias("_parts")), "mix-full")
    part = F.lit(0).cast("long")
    if not full.isEmpty():
        rows = common.attach(rows, full, [*key, "bucket"], "left")
        part = F.coalesce(F.pmod(F.xxhash64("order"), F.col("_parts")), F.lit(0).cast("long"))
    rows = rows.withColumn("part", part)
    bucket = [*key, "bucket", "part"]
    sums = rows.groupBy(*bucket).agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy(*key).orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).join(plan, key)
    within = Window.partitionBy(*bucket).orderBy("hash", "order").rowsBetween(Window.unboundedPreceding, 0)
    rows = common.attach(rows, bases, bucket).withColumn("begin", F.col("base") + F.sum("size").over(within) - F.col("size"))
    passes = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)), lambda k: F.col("begin") + k * F.col("source_size"))
    starts = F.when(F.col("size") > 0, F.filter(passes, lambda v: v + F.col("size") / 2.0 < F.col("target"))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("starts", starts)
    return rows.withColumn("positions", F.transform("starts", lambda v: _time(F.col("pieces"), v / F.col("target")))).withColumn("taken", F.size("starts") * F.col("size"))


def mix(docs: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0), budget_share: float = 1.5, most: float = 2.0, schedules: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", carried: list[str] | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, taken (words) and positions: the training times (ascending) at which the
    document is taken, one for each pass. ``schedules`` (source, knots: array of time and weight): where a source has
    none, weights tilt up for every other source and down for the rest."""
    kept = [c for c in (docs.columns if carried is None else carried) if c.lower() not in NEW]
    text, source = F.col(text_column), F.col(source_column)
    narrow = [source.cast("string").alias("source"), words_of(text).alias("size"), F.xxhash64(F.col(id_column), text, F.lit("mix")).alias("hash")]
    order = F.monotonically_increasing_id()  # tells apart rows that are equal, no others
    if text_column not in kept:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *narrow).withColumn("order", order)
        return _place(common.materialise(rows, "mix-rows"), cycle, budget_share, most, schedules).select("row.*", *NEW)
    names = common.fresh(docs, "file", "row")
    place = common.row_place(docs)
    if place is None:  # nothing lasting to find the rows by: they are written
        (number,) = common.fresh(docs, "number")
        docs = common.materialise(docs.withColumn(number, order), "mix-docs")
        place = [F.lit(-1), F.lit(""), F.col(number)]
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], place[1].alias(names[0]), place[2].alias(names[1]))
    rows = keyed.select(*names, *narrow).withColumn("order", order)
    placed = _place(common.materialise(rows, "mix-rows"), cycle, budget_share, most, schedules).select(*names, *NEW)
    return keyed.select(*[F.col(f"`{c}`") for c in kept], *names).join(common.materialise(placed, "mix-placed"), names).drop(*names)


def range_sorted(mixed: DataFrame, ties: tuple[str, ...] = ("source", "doc_id")) -> DataFrame:
    """One row for each time a document is taken, with its position, range-sorted by position, then by those of ``ties``
    that there are (documents that are not taken are left out)."""
    each = mixed.filter(F.size("positions") > 0).withColumn("position", F.explode("positions"))
    return each.drop("positions").orderBy("position", *[c for c in ties if c in mixed.columns])


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    mixed = mix(docs, carried=["doc_id", "source"])
    first = F.get("positions", 0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"), "positions").orderBy(F.col("position").asc_nulls_last(), "doc_id")
