"""Maintenance runs: isolated steps, summed counters, bounded retention and self-healing lists."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RETAINED, MOST_PENDING = 30, 200


@dataclass
class Step:
    """What a step gave: its numbers, or what went wrong."""

    name: str
    numbers: dict[str, int] = field(default_factory=dict)
    error: str | None = None

    @property
    def line(self) -> str:
        if self.error is not None:
            return f"⚠ {self.name}: {self.error}"
        mark = "✓" if not self.numbers.get("faults") else "⚠"
        return f"{mark} {self.name}: " + ", ".join(f"{k} {v}" for k, v in self.numbers.items())


def attempt(name: str, work: Callable[[], DataFrame | dict]) -> Step:
    """Run one step, whose result is numbers or a table of one row of them."""
    with contextlib.ExitStack() as caught:
        step = Step(name)
        caught.push(lambda kind, e, _: isinstance(e, Exception) and (setattr(step, "error", f"{kind.__name__}: {e}"[:300]) or True))
        found = work()
        step.numbers = found if isinstance(found, dict) else found.first().asDict()
    return step


def run(steps: dict[str, Callable[[], DataFrame | dict]]) -> list[Step]:
    """All steps in order; one that fails keeps its error."""
    return [attempt(name, work) for name, work in steps.items()]


def errors(spark: SparkSession, steps: list[Step]) -> DataFrame:
    """(step, error) of those that failed."""
    return spark.createDataFrame([(s.name, s.error) for s in steps if s.error is not None], "step string, error string")


def counters(rounds: DataFrame, summed: list[str], last: list[str], by: str) -> DataFrame:
    """One row over rounds (round, ...) for each ``by``: sums, and the last round's value of the others."""
    return rounds.groupBy(by).agg(*[F.sum(c).alias(c) for c in summed], *[F.max_by(c, "round").alias(c) for c in last])


def retained(rows: DataFrame, order: str, keep: int = RETAINED) -> DataFrame:
    """The last ``keep`` rows."""
    return rows.orderBy(F.desc(order)).limit(keep)


def heal_pending(pending: DataFrame, current: DataFrame, found: DataFrame, most: int = MOST_PENDING) -> DataFrame:
    """(path): listed paths that still exist, in order (seq), then newly found ones by path, up to ``most``."""
    old = pending.join(current.select("path"), "path", "left_semi").select("path", F.lit(0).alias("_new"), F.col("seq").cast("long").alias("_seq"))
    new = found.select("path").distinct().join(pending.select("path"), "path", "left_anti").select("path", F.lit(1).alias("_new"), F.lit(0).cast("long").alias("_seq"))
    return old.unionByName(new).orderBy("_new", "_seq", "path").limit(most).select("path")


def unique_proposals(proposals: DataFrame) -> DataFrame:
    """Merge proposals (seq, type, canonical, dups) without repeats: same type, name and duplicates whatever their case
    and order; the first wins."""
    key = F.struct(F.lower("type"), F.lower("canonical"), F.array_sort(F.transform("dups", lambda d: F.lower(d))))
    first = F.row_number().over(Window.partitionBy(key).orderBy("seq")) == 1
    return proposals.withColumn("_first", first).filter("_first").drop("_first")
