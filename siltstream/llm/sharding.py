"""Sharding by rendezvous hashing: each record goes to the shard that wins a race for its key.

Shard i of weight w draws -ln(u) / w for a key, with u a number in (0, 1) made from the
md5 of key and shard; the least draw wins. A key's draws don't depend on the other shards:
one shard more takes only the keys that it wins, one shard less gives up only its own, and
shards win in proportion to their weights. DataFrame functions only.

A record's slot numbers its shard without gaps. Records that agree in all that is returned are counted
first, so a row that occurs a billion times is one row until the end; then records are ranked by a 16-bit hash
of key and text, then by key and text, and each of the 65536 ranges starts where the counts of those before it
end. So no task sorts more than one range of one shard, whatever the shard's size and however many records share
a key (or lack one); the sums of counts are at most 65536 rows for each shard.

Defined results: a null key is a key of its own (all such records share a shard); records
that repeat a key share its shard and get slots by their texts' checksums and sizes, one after another; a null text
has size 1 and crc32 0. A text of any length is only measured. Draws that tie go to the lower shard.
Further columns are not read, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NULL_KEY = "\\N"
#: Hexadecimal digits of md5 that make a draw (52 bits) and a range (16 bits).
DRAW, RANGE = 13, 4


def _hex(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def shard_for(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that wins `key` among shards of these weights (0 or less: closed)."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard is open")
    name = F.coalesce(key.cast("string"), F.lit(NULL_KEY))
    draws = []
    for i, w in enumerate(weights):
        if w > 0:
            u = (_hex(F.md5(F.concat(name, F.lit(f":{i}")).cast("binary")), DRAW) + F.lit(0.5)) / F.lit(float(16**DRAW))
            draws.append(F.struct((-F.log(u) / F.lit(float(w))).alias("draw"), F.lit(i).alias("shard")))
    return (F.array_min(F.array(*draws))["shard"] if len(draws) > 1 else draws[0]["shard"]).cast("int")


def with_slots(df: DataFrame, key: str, shard: str, ties: Sequence[str] = ()) -> DataFrame:
    """The rows of df with `slot`: each shard's records numbered from 0, without gaps, in the order of a hash of key and `ties`, then of these. Rows equal in all columns are interchangeable, and made anew from their count."""
    named = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY)), *(F.col(t).cast("string") for t in ties))
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", _hex(F.md5(named.cast("binary")), RANGE).cast("int"))
    counts = rows.groupBy(F.col(shard).alias("_s"), F.col("_range").alias("_r")).agg(F.sum("_n").alias("_all"))
    before = counts.withColumn("_before", F.sum("_all").over(Window.partitionBy("_s").orderBy("_r")) - F.col("_all")).drop("_all")
    in_range = Window.partitionBy(shard, "_range").orderBy(key, *ties, *(c for c in df.columns if c not in (key, shard, *ties))).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("_n").over(in_range), F.lit(0))).join(before, (F.col(shard) == F.col("_s")) & (F.col("_range") == F.col("_r")))
    first = F.col("_before") + F.col("_in")
    # many equal rows in parts of a million, so that no array is longer
    parts = placed.withColumn("_first", first).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(1_000_000).cast("long"))))
    last = F.least(F.col("_n"), F.col("_part") + 1_000_000) - 1
    return parts.select(*df.columns, F.explode(F.transform(F.sequence(F.col("_part"), last), lambda i: F.col("_first") + i)).alias("slot"))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes of the text and 1), text_crc32, law, shard, slot, and grown_shard: the shard with one more of weight 1."""
    text_column = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(text_column) + 1).cast("long").alias("size"),
        F.crc32(text_column.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_for(F.col(key), weights).alias("shard"),
        shard_for(F.col(key), [*weights, 1.0]).alias("grown_shard"),
    )
    return with_slots(rows, key, "shard", ("text_crc32", "size")).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The checksum's polynomial, bit-reversed (a fixed value of CRC-32), applied bit by bit to make its table.
CRC_SQL = r"""
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
bytes AS (SELECT doc_id, text, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
checked AS (SELECT doc_id, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM bytes, crc_table)"""

OP2_SQL = f"""
WITH {CRC_SQL},
draws AS (SELECT doc_id, n + 1 AS size, crc, i, -ln((('0x' || md5(coalesce(doc_id::VARCHAR, '\\N') || ':' || i)[1:13])::BIGINT + 0.5) / 4503599627370496.0) AS draw FROM checked, range(9) r(i)),
won AS (SELECT doc_id, size, crc, arg_min(i, draw) FILTER (i < 8) AS shard, arg_min(i, draw) AS grown FROM draws GROUP BY doc_id, size, crc),
ranked AS (SELECT *, ('0x' || md5(coalesce(doc_id::VARCHAR, '\\N') || ':' || crc || ':' || size)[1:4])::INT AS r FROM won)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY r, doc_id, crc, size) - 1 AS slot, grown::INT AS grown_shard FROM ranked
"""
