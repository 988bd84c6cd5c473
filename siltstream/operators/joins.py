"""Joins in time: as-of, nearest and within a tolerance, none of which compares all with all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, right_at: str, columns: Sequence[str]) -> DataFrame:
    """left with the columns of the last right row at or before it: a union of both, sorted once by key and time, and a fill. right times are unique within `by`."""
    kept = [c for c in left.columns]
    mark = F.struct(*(F.col(c) for c in columns), F.col(right_at).alias("_at"))
    empty = F.lit(None)
    r = right.select(*by, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), mark.alias("_m"))
    l = left.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*kept).alias("_row"))
    both = r.withColumn("_row", empty.cast(l.schema["_row"].dataType)).unionByName(l.withColumn("_m", empty.cast(r.schema["_m"].dataType)))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_m", F.last("_m", ignorenulls=True).over(w)).where("_side = 1")
    return filled.select("_row.*", *(F.col(f"_m.{c}").alias(c) for c in columns), F.col("_m._at").alias("matched_at"))


def within(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, right_at: str, tolerance: int) -> DataFrame:
    """Pairs at most `tolerance` apart (whole numbers), by equal buckets of that width: a left row looks into its own and the two beside it."""
    l = left.withColumn("_b", F.explode(F.array(*(F.floor(F.col(at) / F.lit(max(tolerance, 1))) + k for k in (-1, 0, 1)))))
    r = right.withColumn("_b", F.floor(F.col(right_at) / F.lit(max(tolerance, 1))))
    return l.join(r, [*by, "_b"]).where(F.abs(F.col(at) - F.col(right_at)) <= tolerance).drop("_b")


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, right_at: str, tolerance: int, key: Sequence[str], right_key: Sequence[str]) -> DataFrame:
    """For each left key the nearest right row within the tolerance; of two as near the earlier, then the lesser right key."""
    pairs = within(left, right, by, at, right_at, tolerance)
    best = F.min(F.struct(F.abs(F.col(at) - F.col(right_at)).alias("apart"), F.col(right_at).alias("_at"), *(F.col(c) for c in right_key))).alias("_m")
    return pairs.groupBy(*by, *key).agg(best).select(*by, *key, *(F.col(f"_m.{c}").alias(c) for c in right_key), F.col("_m.apart").alias("apart"))


def reconcile(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, value: str, time_tolerance: int, value_tolerance: float) -> DataFrame:
    """left and right (each unique in by and at), classed: matched or value_mismatch at the same time; of what is left over, time_mismatch for a partner within the tolerance; missing (left only) and extra (right only)."""
    l = left.select(*by, F.col(at).alias("at"), F.col(value).alias("a"))
    r = right.select(*by, F.col(at).alias("at"), F.col(value).alias("b"))
    exact = l.join(r, [*by, "at"], "full_outer")
    same = exact.where("a is not null and b is not null").select(*by, "at", F.when(F.abs(F.col("a") - F.col("b")) <= value_tolerance, "matched").otherwise("value_mismatch").alias("kind"))
    lone_l = exact.where("b is null").select(*by, "at", "a")
    lone_r = exact.where("a is null").select(*by, F.col("at").alias("r_at"), "b")
    near = within(lone_l, lone_r, by, "at", "r_at", time_tolerance)
    moved = near.select(*by, "at").distinct().withColumn("kind", F.lit("time_mismatch"))
    taken = near.select(*by, "r_at").distinct()
    missing = lone_l.join(moved.select(*by, "at"), [*by, "at"], "left_anti").select(*by, "at", F.lit("missing").alias("kind"))
    extra = lone_r.join(taken, [*by, "r_at"], "left_anti").select(*by, F.col("r_at").alias("at"), F.lit("extra").alias("kind"))
    return same.unionByName(moved).unionByName(missing).unionByName(extra)


def dangling(references: DataFrame, targets: DataFrame, reference: str, target: str) -> DataFrame:
    """References that name no target."""
    return references.join(targets.select(F.col(target).alias(reference)).distinct(), reference, "left_anti")


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed run has still to do."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def chain(start: DataFrame, hops: Sequence[tuple[DataFrame, str, str]], key: str) -> DataFrame:
    """Follows references from table to table: each hop is (table, its key, its reference), the reference being the next key."""
    out = start
    for table, on, to in hops:
        out = out.join(table.select(F.col(on).alias(key), F.col(to).alias("_to")), key, "left").drop(key).withColumnRenamed("_to", key)
    return out
