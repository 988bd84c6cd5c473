"""Substreams merged into groups, and their layouts into one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups(df: DataFrame, stream: Sequence[str], order: Sequence[str], opens: Column) -> DataFrame:
    """df with `group`, counted from 1 at each record that opens one; records before the first have group 0: they are orphans."""
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("group", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(w))


def grouped(df: DataFrame, stream: Sequence[str], order: Sequence[str], opens: Column, part: str) -> DataFrame:
    """One row a group: n (records kept), parts (in order), dropped (a part's second record; the first stays)."""
    numbered = groups(df, stream, order, opens).where(F.col("group") > 0)
    w = Window.partitionBy(*stream, "group", part).orderBy(*order)
    firsts = numbered.withColumn("_k", F.row_number().over(w))
    return firsts.groupBy(*stream, "group").agg(
        F.count_if(F.col("_k") == 1).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") == 1, F.struct(*order, F.col(part).alias("_part"))))), lambda x: x["_part"]).alias("parts"),
        F.count_if(F.col("_k") > 1).alias("dropped"),
    )


def orphans(df: DataFrame, stream: Sequence[str], order: Sequence[str], opens: Column) -> DataFrame:
    return groups(df, stream, order, opens).where(F.col("group") == 0).groupBy(*stream).agg(F.count(F.lit(1)).alias("orphans"))


def merged_layout(df: DataFrame, group: Sequence[str], order: Sequence[str], location: str, source: str, most: int = 16) -> DataFrame:
    """Channels of a group: a later part replaces a location or is appended; channels are in order of first appearance, at most `most`: group, location, channel (from 0), source."""
    at = F.struct(*order)
    seen = df.groupBy(*group, location).agg(F.min(at).alias("_first"), F.max_by(source, at).alias("source"))
    w = Window.partitionBy(*group).orderBy("_first")
    return seen.withColumn("channel", F.row_number().over(w) - 1).where(F.col("channel") < most).drop("_first")


def missing_groups(df: DataFrame, stream: Sequence[str], group: str) -> DataFrame:
    """Group numbers between a stream's first and last that it lacks."""
    span = df.groupBy(*stream).agg(F.min(group).alias("a"), F.max(group).alias("b"))
    return span.select(*stream, F.explode(F.sequence("a", "b")).alias(group)).join(df.select(*stream, group).distinct(), [*stream, group], "left_anti")


def interleaved(df: DataFrame, channels: Sequence[str]) -> Column:
    """Arrays of samples by channel as one array, sample by sample."""
    return F.flatten(F.transform(F.arrays_zip(*channels), lambda s: F.array(*(s[c] for c in channels))))


def channel_mask(labels: Column, bits: dict[str, int]) -> Column:
    """The bit mask of an array of channel labels."""
    of = F.create_map(*(F.lit(x) for kv in bits.items() for x in kv))
    return F.aggregate(labels, F.lit(0), lambda m, label: m.bitwiseOR(F.shiftleft(F.lit(1), 0) * F.coalesce(F.pow(F.lit(2), of[label]).cast("int"), F.lit(0))))


def from_mask(mask: Column, n: int) -> Column:
    """The numbers of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(mask, i) == 1)
