"""Which fields tell two classes of rows apart: by values that never, or hardly ever, occur in both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_values(df: DataFrame, key: Column, fields: Sequence[str]) -> DataFrame:
    """(field, value, yes, no): how many rows of either class have the value; a missing one is a value too. key null is the no side."""
    rows = df.select(F.coalesce(key, F.lit(False)).alias("_y"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("_f"))
    return rows.groupBy("_f.field", "_f.value").agg(F.count_if("_y").alias("yes"), F.count_if(~F.col("_y")).alias("no"))


def splits(df: DataFrame, key: Column, fields: Sequence[str], smaller_at_least: int = 10) -> DataFrame:
    """For each field: distinct values, overlap (sum of the lesser counts), and kind: exact (no overlap), near (at most max(2, a tenth of the rows), if the smaller class has smaller_at_least), none; or continuous, if it has more than max(4, half the rows) distinct values."""
    counted = field_values(df, key, fields)
    out = counted.groupBy("field").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum(F.least("yes", "no")).alias("overlap"), F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    rows = F.col("yes") + F.col("no")
    kind = (
        F.when(F.col("distinct_values") > F.greatest(F.lit(4), F.floor(rows / 2)), "continuous")
        .when((F.col("yes") == 0) | (F.col("no") == 0), "none")
        .when(F.col("overlap") == 0, "exact")
        .when((F.col("overlap") <= F.greatest(F.lit(2), F.floor(rows / 10))) & (F.least("yes", "no") >= smaller_at_least), "near")
        .otherwise("none")
    )
    return out.withColumn("kind", kind)


def pair_splits(df: DataFrame, key: Column, fields: Sequence[str]) -> DataFrame:
    """Pairs of fields whose values together split exactly: field_a, field_b, overlap 0."""
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    joint = df.select(F.coalesce(key, F.lit(False)).alias("_y"), F.explode(F.array(*(F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb")) for a, b in pairs))).alias("_f"))
    counted = joint.groupBy("_f.field_a", "_f.field_b", "_f.va", "_f.vb").agg(F.count_if("_y").alias("yes"), F.count_if(~F.col("_y")).alias("no"))
    return counted.groupBy("field_a", "field_b").agg(F.sum(F.least("yes", "no")).alias("overlap"))
