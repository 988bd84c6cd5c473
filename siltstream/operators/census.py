"""Censuses: exact counts of values over streams and libraries, with what never or rarely occurs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def value_counts(df: DataFrame, value: str, low: int, high: int, by: Sequence[str] = ()) -> DataFrame:
    """How often each value of low..high occurs, 0 included; a row with value null counts what lies outside (null values too)."""
    inside = F.when(F.col(value).between(low, high), F.col(value).cast("long"))
    counted = df.groupBy(*by, inside.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    domain = df.sparkSession.range(low, high + 1).select(F.col("id").alias("value")).unionByName(df.sparkSession.sql("SELECT cast(null AS long) AS value"))
    if by:
        domain = df.select(*by).distinct().withColumn("value", F.explode(F.concat(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long")), F.array(F.lit(None).cast("long")))))
    on = counted["value"].eqNullSafe(domain["value"])
    for c in by:
        on = on & counted[c].eqNullSafe(domain[c])
    return domain.join(counted, on, "left").select(*(domain[c] for c in by), domain["value"], F.coalesce("n", F.lit(0)).alias("n"))


def other_than(counted: DataFrame, value: int, by: Sequence[str] = ()) -> DataFrame:
    """How many of value_counts are not `value`, and how many there are."""
    return counted.groupBy(*by).agg(F.coalesce(F.sum(F.when(~F.col("value").eqNullSafe(F.lit(value)), F.col("n"))), F.lit(0)).alias("others"), F.sum("n").alias("total"))


def library_census(df: DataFrame, stream: str, counter: Sequence[str], count: Column) -> DataFrame:
    """For each counter the sum over all streams, and how many streams have more than 0: first within a stream, then over streams."""
    within = df.groupBy(stream, *counter).agg(F.sum(count).alias("_n"))
    return within.groupBy(*counter).agg(F.sum("_n").alias("total"), F.count_if(F.col("_n") > 0).alias("streams"))


def never(census: DataFrame) -> DataFrame:
    return census.where("total = 0")


def rare(df: DataFrame, stream: str, counter: Sequence[str], most: int) -> DataFrame:
    """Counters that at most `most` streams carry, with those streams in order. Counts come first, so only rare counters' streams are gathered."""
    carriers = df.select(*counter, stream).distinct()
    few = carriers.groupBy(*counter).agg(F.count(F.lit(1)).alias("streams")).where(F.col("streams") <= most)
    return carriers.join(few, list(counter)).groupBy(*counter, "streams").agg(F.array_sort(F.collect_list(stream)).alias("carriers"))


def part_and_whole(df: DataFrame, parts: Sequence[str], count: Column) -> DataFrame:
    """Counts by part, by every prefix of the parts, and over all ("all" for a part that is summed over): one pass by ROLLUP."""
    out = df.rollup(*parts).agg(count.alias("n"), F.grouping_id().alias("level"))
    return out.select(*(F.when(F.col("level").bitwiseAND(1 << (len(parts) - 1 - i)) != 0, "all").otherwise(F.col(c).cast("string")).alias(c) for i, c in enumerate(parts)), "n")


def one_schema(df: DataFrame, schema: str) -> DataFrame:
    """One row: the number of schemas, and whether there is only one."""
    return df.agg(F.count_distinct(schema).alias("schemas")).withColumn("homogeneous", F.col("schemas") <= 1)


def projection_tally(df: DataFrame, group: Column, name: str) -> DataFrame:
    """Rows by a projection, those without one left out."""
    return df.groupBy(group.alias(name)).agg(F.count(F.lit(1)).alias("n")).where(F.col(name).isNotNull())


def mode_of(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The commonest value and how often it occurs; the least of equally common ones."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("_m")).select(*by, F.col("_m.v").alias(value), (-F.col("_m.m")).alias("n"))


def match_apart(df: DataFrame, a: Column, b: Column, tolerance: float, by: Sequence[str] = ()) -> DataFrame:
    """How many rows have a + b within the tolerance of 0, how many are apart, and how many lack either."""
    kind = F.when(a.isNull() | b.isNull(), "missing").when(F.abs(a + b) <= tolerance, "match").otherwise("apart")
    return df.groupBy(*by, kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def publishable(df: DataFrame, by: Sequence[str], item: str, most: int = 3) -> DataFrame:
    """Per group the distinct items in order, or only their number if there are more than `most`. Only groups to be listed are gathered."""
    pairs = df.select(*by, item).distinct()
    sizes = pairs.groupBy(*by).agg(F.count(item).alias("n"))
    listed = pairs.join(sizes.where(F.col("n") <= most), list(by)).groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return sizes.join(listed, list(by), "left").select(*by, "n", "items")


def _median(counts: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The exact median of values that occur `n` times each: what stands in the middle of the running sums. Each distinct value is one row, in a sort that can spill."""
    up_to = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_up", F.sum("n").over(up_to))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    placed = placed.join(totals, list(by)) if by else placed.crossJoin(F.broadcast(totals))  # one row
    low, high = (F.min(F.when(F.col("_up") * 2 > F.col("_all") + k, F.col(value))) for k in (-1, 0))
    return placed.groupBy(*by).agg(((low + high) / 2).alias("median"))


def median_mad(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The exact median and the median absolute deviation from it; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    medians = _median(counts, "_v", by)
    joined = counts.join(medians, list(by)) if by else counts.crossJoin(F.broadcast(medians))  # one row
    away = joined.groupBy(*by, "median", F.abs(F.col("_v") - F.col("median")).alias("_d")).agg(F.sum("n").alias("n"))
    return _median(away.withColumnRenamed("median", "_m"), "_d", [*by, "_m"]).select(*by, F.col("_m").alias("median"), F.col("median").alias("mad"))


def peak_first(df: DataFrame, value: str, place: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The greatest value and the first place that has it."""
    best = F.min(F.struct((-F.col(value)).alias("m"), *(F.col(c) for c in place))).alias("_m")
    return df.groupBy(*by).agg(best).select(*by, (-F.col("_m.m")).alias("peak"), *(F.col(f"_m.{c}").alias(f"peak_{c}") for c in place))


def unpivot_leaves(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(ids, counter, value): a row for each counter column."""
    return df.unpivot(list(ids), list(columns), "counter", "value")


def ranked(df: DataFrame, by: str, most: int, ties: Sequence[str]) -> DataFrame:
    """The `most` rows of greatest `by`, with their rank. Spark keeps `most` rows of each task, and only these meet."""
    top = df.orderBy(F.col(by).desc(), *ties).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc(), *ties)))
