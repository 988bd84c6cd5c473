"""Timelines: states as changes, sparse updates filled in, and blocks between events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _differs(columns: Sequence[str], w) -> Column:
    """Whether any of the columns differs from the record before; null equals null."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return out


def changes(df: DataFrame, element: Sequence[str], arrival: Sequence[str], state: Sequence[str], ramp: Sequence[str] = (), restates: Column | None = None) -> DataFrame:
    """The records at which an element's state changes (its first always), with the state before as previous_*.

    Order is by arrival, not by position. Where `restates`, the columns of `ramp` are not compared.
    """
    w = Window.partitionBy(*element).orderBy(*arrival)
    differs = _differs(state, w)
    if ramp:
        differs = differs | (_differs(ramp, w) & ~F.coalesce(restates if restates is not None else F.lit(False), F.lit(False)))
    out = df.withColumn("_first", F.row_number().over(w) == 1).withColumn("_changed", differs)
    for c in state:
        out = out.withColumn(f"previous_{c}", F.lag(c).over(w))
    return out.where("_first or _changed").drop("_first", "_changed")


def out_of_order(events: DataFrame, element: Sequence[str], arrival: Sequence[str], position: str) -> DataFrame:
    """Events that lie before the event that came before them."""
    w = Window.partitionBy(*element).orderBy(*arrival)
    return events.withColumn("before", F.lag(position).over(w)).where(F.col(position) < F.col("before"))


def forward_fill(df: DataFrame, element: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """df with each field's nulls replaced by the last value before."""
    w = Window.partitionBy(*element).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in fields})


def delta_encode(df: DataFrame, element: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """df with a field null where it is as before; forward_fill brings it back. (A null that follows a value can't be told from it.)"""
    w = Window.partitionBy(*element).orderBy(*order)
    return df.withColumns({c: F.when(F.coalesce(F.col(c) == F.lag(c).over(w), F.lit(False)), None).otherwise(F.col(c)) for c in fields})


def blocks(events: DataFrame, element: Sequence[str], position: str, arrival: Sequence[str], end: Column, state: Sequence[str]) -> DataFrame:
    """Blocks from events: of one position the last to arrive; start, duration up to the next or to the end; events at or beyond the end go, and blocks at the tail that repeat the one before (not the first)."""
    kept = events.where(F.col(position) < end)
    last = Window.partitionBy(*element, position).orderBy(*(F.col(c).desc() for c in arrival))
    kept = kept.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    w = Window.partitionBy(*element).orderBy(position)
    back = Window.partitionBy(*element).orderBy(F.col(position).desc()).rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("_new", (F.row_number().over(w) == 1) | _differs(state, w))
    kept = kept.withColumn("_later", F.max(F.col("_new").cast("int")).over(back)).where("_later = 1").drop("_later", "_new")
    return kept.withColumn("start", F.col(position)).withColumn("duration", F.coalesce(F.lead(position).over(w), end) - F.col(position))


def tiling_faults(df: DataFrame, element: Sequence[str], start: str, duration: str) -> DataFrame:
    """Blocks that don't end where the next begins."""
    w = Window.partitionBy(*element).orderBy(start)
    return df.withColumn("next_start", F.lead(start).over(w)).where(F.col("next_start") != F.col(start) + F.col(duration))


def against_first(df: DataFrame, stream: Sequence[str], order: Sequence[str], config: Sequence[str]) -> DataFrame:
    """Records whose configuration differs from the stream's first, with the first column that does (`changed`)."""
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reason = F.lit(None).cast("string")
    out = df
    for c in config:
        out = out.withColumn(f"_first_{c}", F.first(c).over(w))
    for c in reversed(config):
        reason = F.when(~F.col(c).eqNullSafe(F.col(f"_first_{c}")), F.lit(c)).otherwise(reason)
    return out.withColumn("changed", reason).where("changed is not null").drop(*(f"_first_{c}" for c in config))


def against_previous(df: DataFrame, stream: Sequence[str], order: Sequence[str], config: Sequence[str]) -> DataFrame:
    """Records whose configuration differs from the record before; `changed` names the first column that does."""
    w = Window.partitionBy(*stream).orderBy(*order)
    reason = F.lit(None).cast("string")
    for c in reversed(config):
        reason = F.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), F.lit(c)).otherwise(reason)
    return df.withColumn("_k", F.row_number().over(w)).withColumn("changed", reason).where("_k > 1 and changed is not null").drop("_k")


def displacements(events: DataFrame, element: Sequence[str], position: str, values: Sequence[str]) -> DataFrame:
    """For each event after an element's first: the time since the one before, and the distance of its values."""
    w = Window.partitionBy(*element).orderBy(position)
    squares = F.lit(0.0)
    for c in values:
        squares = squares + F.pow(F.col(c) - F.lag(c).over(w), 2)
    return events.withColumn("gap", F.col(position) - F.lag(position).over(w)).withColumn("distance", F.sqrt(squares)).where("gap is not null")


def value_at(events: DataFrame, probes: DataFrame, element: str, position: str, value: str, probe: str) -> DataFrame:
    """The piecewise linear value at each probe time: held before the first event and after the last. A union of events and probes sorted once: no range join."""
    both = events.select(element, F.col(position).alias("t"), F.col(value).alias("v"), F.lit(0).alias("_p")).unionByName(probes.select(element, F.col(probe).alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("_p")))
    before = Window.partitionBy(element).orderBy("t", "_p").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(element).orderBy("t", "_p").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("_p") == 0, F.struct("t", "v"))
    known = both.withColumn("_a", F.last(at, ignorenulls=True).over(before)).withColumn("_b", F.first(at, ignorenulls=True).over(after)).where("_p = 1")
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("t") - a["t"]) / (b["t"] - a["t"])
    return known.select(element, F.col("t").alias(probe), F.when(a.isNull(), b["v"]).when(b.isNull() | (b["t"] == a["t"]), a["v"]).otherwise(line).alias("value"))


def ramp_segments(events: DataFrame, element: Sequence[str], position: str, ramp: str, value: str) -> DataFrame:
    """The pieces of a trajectory: each event moves its element from the target before it (its own, for the first) to its own over `ramp` samples: begins, ends, from_value, to_value, holds_until (where the next event begins; null after the last)."""
    w = Window.partitionBy(*element).orderBy(position)
    before = F.coalesce(F.lag(value).over(w), F.col(value))
    return events.select(*element, F.col(position).alias("begins"), (F.col(position) + F.col(ramp)).alias("ends"), before.alias("from_value"), F.col(value).alias("to_value"), F.lead(position).over(w).alias("holds_until"))


def room_point(x: Column, y: Column, z: Column, fine: Sequence[Column]) -> tuple[Column, Column, Column]:
    """A coded position (x and y in 62nds, z in 15ths) with its finer steps (a fifth of a step each) as room coordinates, held within the room."""
    def within(c: Column, low: float) -> Column:
        return F.greatest(F.least(c, F.lit(1.0)), F.lit(low))

    return within(x / 62.0 + fine[0] / 310.0, 0.0), within(y / 62.0 + fine[1] / 310.0, 0.0), within(z / 15.0 + fine[2] / 75.0, -1.0)


def first_of_kind(elements: Column, kind: str) -> Column:
    """The first struct of an array whose field `kind` says so; null if there is none."""
    return F.get(F.filter(elements, lambda e: e["kind"] == kind), F.lit(0))


def gain_and_size_counts(updates: Column) -> dict[str, Column]:
    """Of an array of updates (gain in dB, null: the default; muted; size): changed gains, mutes (counted apart), and sizes that aren't zero."""
    return {
        "gains": F.size(F.filter(updates, lambda u: F.coalesce(~u["muted"] & (u["gain"] != 0), F.lit(False)))),
        "muted": F.size(F.filter(updates, lambda u: F.coalesce(u["muted"], F.lit(False)))),
        "sized": F.size(F.filter(updates, lambda u: F.coalesce(u["size"] != 0, F.lit(False)))),
    }
