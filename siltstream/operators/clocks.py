"""Clocks and buffers: modular clocks unwrapped, jumps, sequence gaps, and occupancy over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS = 65_536


def unwrap(df: DataFrame, stream: Sequence[str], order: Sequence[str], clock: str, modulus: int = MODULUS) -> DataFrame:
    """df with `unwrapped`: the clock counted on where it starts again (a step back of more than half)."""
    w = Window.partitionBy(*stream).orderBy(*order)
    step = F.when(F.col(clock) + modulus // 2 < F.lag(clock).over(w), F.lit(modulus).cast("long")).otherwise(F.lit(0).cast("long"))
    return df.withColumn("_s", step).withColumn("unwrapped", F.col(clock) + F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def interval_jumps(df: DataFrame, stream: Sequence[str], order: Sequence[str], clock: str, least: Column, most: Column, modulus: int = MODULUS) -> DataFrame:
    """df with `interval` (since the record before, modulo) and `jump`: it is below least or above most. A stream's first record never jumps."""
    w = Window.partitionBy(*stream).orderBy(*order)
    interval = F.pmod(F.col(clock) - F.lag(clock).over(w), F.lit(modulus))
    return df.withColumn("interval", interval).withColumn("jump", F.coalesce((F.col("interval") < least) | (F.col("interval") > most), F.lit(False)))


def sequence_gaps(df: DataFrame, stream: Sequence[str], order: Sequence[str], number: str, wrap_after: int | None = None) -> DataFrame:
    """Records whose number doesn't follow the one before: `expected`, `kind`. 0 after the first is a restart; a number at or beyond wrap_after is followed by 1."""
    w = Window.partitionBy(*stream).orderBy(*order)
    before = F.lag(number).over(w)
    follows = before + 1 if wrap_after is None else F.when(before >= wrap_after, F.lit(1)).otherwise(before + 1)
    kind = F.when(before.isNull(), None).when(F.col(number) == 0, "restart").when(F.col(number) != follows, "gap")
    return df.withColumn("expected", follows).withColumn("kind", kind).where(F.col("kind").isNotNull())


def sync_spacing(df: DataFrame, stream: Sequence[str], unit: str, sync: Column) -> DataFrame:
    """df with the last sync before each record and `since`: how far back it lies."""
    w = Window.partitionBy(*stream).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("last_sync", F.last(F.when(sync, F.col(unit)), ignorenulls=True).over(w)).withColumn("since", F.col(unit) - F.col("last_sync"))


def occupancy(df: DataFrame, stream: Sequence[str], arrival: Column, removal: Column, size: Column, unit: str) -> DataFrame:
    """How full a buffer is after each arrival: what came in less what left by then. At one time removals go first, then units in order."""
    rows = df.select(*stream, F.col(unit).alias("unit"), F.explode(F.array(F.struct(arrival.alias("t"), F.lit(1).alias("k"), size.alias("d")), F.struct(removal.alias("t"), F.lit(0).alias("k"), (-size).alias("d")))).alias("_e"))
    flat = rows.select(*stream, "unit", "_e.t", "_e.k", "_e.d")
    w = Window.partitionBy(*stream).orderBy("t", "k", "unit").rowsBetween(Window.unboundedPreceding, 0)
    return flat.withColumn("held", F.sum("d").over(w)).where("k = 1").select(*stream, "unit", "t", "held")


def reset_counts(df: DataFrame, stream: Sequence[str], order: Sequence[str], reset: Column) -> DataFrame:
    """df with `session`: a number that grows at each record that resets the stream."""
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("session", F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(w))


def gap_fill(clock_step: Column, gap_bytes: Column, average: Column, per_unit: int, modulus: int = MODULUS) -> Column:
    """Samples missing in a gap: the clock's step, if it lies within max(estimate, two units) of the estimate from bytes; else null."""
    step = F.pmod(clock_step, F.lit(modulus))
    estimate = gap_bytes / average * per_unit
    return F.when(F.abs(step - estimate) <= F.greatest(estimate, F.lit(2.0 * per_unit)), step)


def ceil_div(a: Column, b: Column) -> Column:
    """a / b rounded up, for whole numbers; null where b is 0."""
    return F.when(b != 0, F.expr("0") - F.floor(-a / b)).cast("long")
