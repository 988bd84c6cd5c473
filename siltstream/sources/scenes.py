"""Object scenes from XML and from text dumps, as tables of blocks and of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import timecode_samples

#: What is read of a block; attributes begin with "_".
BLOCK_SCHEMA = "_audioBlockFormatID string, _rtime string, _duration string, gain double, jumpPosition string, position array<struct<_VALUE: double, _coordinate: string>>"


def read_blocks(spark: SparkSession, path: str, rate: int) -> DataFrame:
    """channel, block, start, duration (samples), x, y, z, gain of every audioBlockFormat, which names its channel in its id (AB_channel_block).

    Files are split at the tag, so a long file is read by several tasks.
    """
    rows = spark.read.format("xml").option("rowTag", "audioBlockFormat").schema(BLOCK_SCHEMA).load(path)
    part = lambda k: F.regexp_extract("_audioBlockFormatID", r"^AB_([0-9a-fA-F]{8})_([0-9a-fA-F]{8})$", k)
    at = lambda c: F.filter("position", lambda p: p["_coordinate"] == c)
    return rows.select(
        F.nullif(part(1), F.lit("")).alias("channel"),
        F.conv(F.nullif(part(2), F.lit("")), 16, 10).cast("long").alias("block"),
        timecode_samples(F.col("_rtime"), rate).alias("start"),
        timecode_samples(F.col("_duration"), rate).alias("duration"),
        *(F.get(at(c), F.lit(0))["_VALUE"].alias(c.lower()) for c in ("X", "Y", "Z")),
        F.coalesce("gain", F.lit(1.0)).alias("gain"),
    )


def read_elements(spark: SparkSession, path: str, tag: str, attributes: list[str], references: list[str] | None = None) -> DataFrame:
    """A row for each element of a tag: its attributes, and for each kind of reference the ids that it names."""
    refs = references or []
    schema = ", ".join([*(f"_{a} string" for a in attributes), *(f"{r} array<string>" for r in refs)])
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows.select(*(F.col(f"_{a}").alias(a) for a in attributes), *(F.col(r) for r in refs))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """path, line, item, field, value of a text dump: a line "item 3: a=1 b=-0.5" gives a row for each field."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    named = lines.select("path", "line", F.regexp_extract("text", r"^\s*([\w ]+?)\s*:", 1).alias("item"), F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*=[^\s,]+)"), 1)).alias("pair"))
    return named.select("path", "line", "item", F.substring_index("pair", "=", 1).alias("field"), F.regexp_extract("pair", "=(.*)$", 1).alias("value"))
