"""Regions: runs of faulty records, from their first to the record that makes the stream whole again."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, stream: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Maximal runs of records that follow one another and have the flag: run, first_*, last_*, length. One sort by stream serves both windows."""
    w = Window.partitionBy(*stream).orderBy(*order)
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    opened = marked.withColumn("_o", (F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))).cast("int"))
    numbered = opened.withColumn("run", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_f")
    at = F.struct(*order)
    return numbered.groupBy(*stream, "run").agg(F.min(at).alias("_a"), F.max(at).alias("_b"), F.count(F.lit(1)).alias("length")).select(
        *stream, "run", *(F.col(f"_a.{c}").alias(f"first_{c}") for c in order), *(F.col(f"_b.{c}").alias(f"last_{c}") for c in order), "length"
    )


def merged_regions(faults: DataFrame, stream: Sequence[str], unit: str, last_unit: Column, reach: int = 1) -> DataFrame:
    """Faults at one unit or within `reach` of the last merge into a region; entry is the unit after it, null if it ends at the stream's last unit (last_unit)."""
    w = Window.partitionBy(*stream).orderBy(unit)
    opened = faults.withColumn("_o", F.coalesce((F.col(unit) - F.lag(unit).over(w) > reach).cast("int"), F.lit(1)))
    numbered = opened.withColumn("region", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*stream, "region").agg(F.min(unit).alias("first_unit"), F.max(unit).alias("last_unit"), F.count(F.lit(1)).alias("faults"), F.max(last_unit).alias("_end"))
    return out.withColumn("entry_unit", F.when(F.col("last_unit") < F.col("_end"), F.col("last_unit") + 1)).drop("_end")


def until_restart(df: DataFrame, stream: Sequence[str], unit: str, fault: Column, restart: Column) -> DataFrame:
    """Regions that a fault opens and the next restart closes: first_unit, last_unit, entry_unit (null if none came), faults. For streams of one part; windows only."""
    w = Window.partitionBy(*stream).orderBy(unit)
    marked = df.withColumn("_f", F.coalesce(fault, F.lit(False))).withColumn("_r", F.coalesce(restart, F.lit(False)) & ~F.col("_f"))
    # faults between two restarts belong together
    numbered = marked.withColumn("_g", F.sum(F.col("_r").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    after = Window.partitionBy(*stream).orderBy(unit).rowsBetween(1, Window.unboundedFollowing)
    numbered = numbered.withColumn("_next", F.min(F.when(F.col("_r"), F.col(unit))).over(after)).withColumn("_end", F.max(unit).over(Window.partitionBy(*stream)))
    out = numbered.where("_f").groupBy(*stream, "_g").agg(F.min(unit).alias("first_unit"), F.max(unit).alias("_last"), F.first("_next").alias("entry_unit"), F.count(F.lit(1)).alias("faults"), F.max("_end").alias("_end"))
    return out.select(*stream, "first_unit", F.when(F.col("entry_unit").isNull(), F.col("_end")).otherwise(F.greatest("_last", F.col("entry_unit") - 1)).alias("last_unit"), "entry_unit", "faults")


def until_all_restart(df: DataFrame, stream: str, unit: str, damaged: str, restarted: str) -> DataFrame:
    """Regions of streams of several parts (bit masks): a fault adds its parts to those damaged, a clean restart takes its parts away, and the region closes when none is left.

    The set of damaged parts depends on all that came before, so a stream is read in order; streams are independent.
    """
    kind = df.schema[stream].dataType.simpleString()

    def closed(pdf: pd.DataFrame) -> pd.DataFrame:
        out, open_, left = [], None, 0
        for row in pdf.sort_values(unit, kind="stable").itertuples(index=False):
            at, bad, new = getattr(row, unit), int(getattr(row, damaged) or 0), int(getattr(row, restarted) or 0)
            if open_ is not None and new & left & ~bad:
                left &= ~new
                if not left:
                    out.append((*open_[:2], max(open_[2], at - 1), at, open_[3]))
                    open_ = None
            if bad:
                if open_ is None:
                    open_ = [getattr(row, stream), at, at, 0]
                left |= bad
                open_[2], open_[3] = at, open_[3] | bad
        if open_ is not None:
            out.append((*open_[:2], int(pdf[unit].max()), None, open_[3]))
        return pd.DataFrame(out, columns=[stream, "first_unit", "last_unit", "entry_unit", "parts"]).astype({"entry_unit": "Int64"})

    return df.select(stream, unit, damaged, restarted).groupBy(stream).applyInPandas(closed, f"{stream} {kind}, first_unit long, last_unit long, entry_unit long, parts long")


def capped(regions: DataFrame, stream: Sequence[str], order: Sequence[str], most: int = 10_000) -> DataFrame:
    """The first `most` regions of each stream, and in `overflow` how many more it has."""
    numbered = regions.withColumn("_k", F.row_number().over(Window.partitionBy(*stream).orderBy(*order)))
    counts = regions.groupBy(*stream).agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("overflow"))
    return numbered.where(F.col("_k") <= most).drop("_k").join(counts, list(stream))
