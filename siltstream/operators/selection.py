"""Which records to take, where they come out, and how tracks are told apart."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .findings import SEVERITIES, severity_rank


def from_sync(df: DataFrame, stream: Sequence[str], unit: str, sync: Column, target: Column) -> DataFrame:
    """Each stream from its first sync whose unit ends after the target (a unit number, perhaps with a fraction); a stream without one gives nothing."""
    begin = df.where(sync & (F.col(unit) + 1 > target)).groupBy(*stream).agg(F.min(unit).alias("_begin"))
    return df.join(begin, list(stream)).where(F.col(unit) >= F.col("_begin")).drop("_begin")


def head(df: DataFrame, unit: str, n: int) -> DataFrame:
    return df.where(F.col(unit) < n)


def cut(df: DataFrame, group: str, first: int, last: int) -> DataFrame:
    """Groups first to last, numbered from 0 again."""
    return df.where(F.col(group).between(first, last)).withColumn(group, F.col(group) - first)


def at_least(df: DataFrame, severity: str, fail_on: str) -> DataFrame:
    """Findings of the severity fail_on or a graver one."""
    return df.where(severity_rank(F.col(severity)) >= SEVERITIES.index(fail_on))


def clauses(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Rows that meet every FIELD=VALUE; a value is compared as text, and an empty one means null."""
    for clause in wanted:
        name, sign, value = clause.partition("=")
        if not sign or name not in df.columns:
            raise ValueError(f"not FIELD=VALUE of this table: {clause!r}")
        df = df.where(F.col(name).cast("string").eqNullSafe(F.lit(value or None)))
    return df


def output_positions(df: DataFrame, stream: Sequence[str], order: Sequence[str], silence: Column, samples: Column) -> DataFrame:
    """df with `begins` and `ends`: where each record's samples come out, after the silence put in before them."""
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_n", samples).withColumn("ends", F.sum(silence + samples).over(w))
    return out.withColumn("begins", F.col("ends") - F.col("_n")).drop("_n")


def clean_average(df: DataFrame, stream: Sequence[str], order: Sequence[str], clean: Column, size: Column) -> DataFrame:
    """df with `average`: of the clean records before each (itself not)."""
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("average", F.avg(F.when(clean, size)).over(w))


def title_and_year(name: Column, release: str | None = None) -> tuple[Column, Column]:
    """Title and year of a file name such as "Some.Title.1999.rest": the last number of a year's form ends the title; without one the whole name is the title. With `release`, a pattern of the words that follow a year, a number that stands before other words belongs to the title."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[A-Za-z0-9]{2,4}$", "")
    rest = r"(?:[ ._)\]].*)?$" if release is None else rf"(?:[ ._)\]]+(?:(?:{release})(?:[ ._(\[].*)?)?)?$"
    year = F.regexp_extract(stem, rf"^.+[ ._(\[]((?:19|20)\d\d){rest}", 1)
    title = F.when(year != "", F.regexp_extract(stem, rf"^(.+)[ ._(\[](?:19|20)\d\d{rest}", 1)).otherwise(stem)
    return F.trim(F.regexp_replace(title, r"[._]+", " ")), F.nullif(year, F.lit("")).cast("int")


def reordered(samples: Column, order: Sequence[int]) -> Column:
    """An array's elements in another order."""
    return F.array(*(F.get(samples, F.lit(k)) for k in order))


def file_set_diff(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Names that only one side has: name, side."""
    joined = a.select(name).distinct().withColumn("_a", F.lit(1)).join(b.select(name).distinct().withColumn("_b", F.lit(1)), name, "full_outer")
    return joined.where("_a is null or _b is null").select(name, F.when(F.col("_b").isNull(), "a").otherwise("b").alias("side"))


def greedy_pairs(scores: DataFrame, scene: str, left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs, the best score first, ties by left then right: each choice depends on those before it, so a scene (a few tracks) is one task; scenes are independent."""
    kinds = {c: scores.schema[c].dataType.simpleString() for c in (scene, left, right, score)}

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, left, right], ascending=[False, True, True], kind="stable")
        used_l, used_r, keep = set(), set(), []
        for i, (a, b) in enumerate(zip(pdf[left], pdf[right], strict=True)):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                keep.append(i)
        return pdf.iloc[keep]

    return scores.select(scene, left, right, score).groupBy(scene).applyInPandas(chosen, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def distance_table(a: DataFrame, b: DataFrame, position: str, track: str, value: str) -> DataFrame:
    """RMS distance of every track of a to every track of b, over the positions that both have: (track_a, track_b, rms). Joined by position; the sums are partial, so no task holds a track."""
    joined = a.select(position, F.col(track).alias("track_a"), F.col(value).alias("_x")).join(b.select(position, F.col(track).alias("track_b"), F.col(value).alias("_y")), position)
    return joined.groupBy("track_a", "track_b").agg(F.sqrt(F.avg(F.pow(F.col("_x") - F.col("_y"), 2))).alias("rms"))


def trajectory_loss(a: DataFrame, b: DataFrame, element: str, value: str, probe: str, threshold: float) -> DataFrame:
    """Of two values at each probe: n, greatest and mean difference, the 95th percentile by nearest rank, and how many lie over the threshold."""
    d = a.select(element, probe, F.col(value).alias("_a")).join(b.select(element, probe, F.col(value).alias("_b")), [element, probe]).select(element, probe, F.abs(F.col("_a") - F.col("_b")).alias("d"))
    ranked = d.withColumn("_k", F.row_number().over(Window.partitionBy(element).orderBy("d", probe))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(element)))
    return ranked.groupBy(element).agg(
        F.max("_n").alias("n"), F.max("d").alias("max_loss"), F.avg("d").alias("mean_loss"),
        F.min(F.when(F.col("_k") >= F.ceil(F.col("_n") * 95 / 100), F.col("d"))).alias("p95"), F.count_if(F.col("d") > threshold).alias("over"),
    )
