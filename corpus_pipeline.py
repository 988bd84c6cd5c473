"""From documents to sampled token ids: quality rules, line dedup, near duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame; all but the
last return the columns of documents. What stays of repeated keys, nulls and empty texts is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstream.llm import decontam, jaccard, linededup, rules, sampling
from siltstream.llm._pieces import Vocabulary
from siltstream.llm._shared import through_table
from siltstream.llm.tokencount import PIECES


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rule or meet a learned rule go; so do null and empty texts, which have no words. Repeated rows share their verdict; an empty table gives an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    picked = rules.sample_labels(labels).select(F.col("_k").alias("_key")).distinct()
    sample = docs.select(F.col("doc_id").alias("_key"), F.col("text").alias("_text")).join(F.broadcast(picked), "_key")  # rules.LABELLED keys at most
    counted = through_table(rules.with_statistics(sample, "_text").drop("_text"), "quality")
    found = rules.fit_rules(counted, labels.select(F.col("doc_id").alias("_key"), "quality"), key="_key")
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text"))
    return rules.where_kept(rules.with_statistics(packed, "_text").drop("_text"), found).select("_doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of a line go; so does a row that had words and has none left. n_chars, if there is one, follows the text. A null or empty text stays; rows that repeat key and text are one document; an empty table gives an empty one."""
    out = linededup.dedup_lines(docs)
    word = r"[^\x09-\x0D\x20]"
    changed = F.col("_ld_equal") + F.col("_ld_near") > 0
    out = out.where(~(changed & ~F.coalesce(F.col("text"), F.lit("")).rlike(word)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _identified(docs: DataFrame) -> DataFrame:
    """The rows as `row`, beside `rid`, a 64-bit hash of doc_id and text: rows that repeat both are one document."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("rid"))


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (0.8 or more alike) the one of least doc_id (then of least hash) stays, one without doc_id only if none has one. Of rows that repeat doc_id and text one stays, the least by its other columns as text. Unlike rows that share a doc_id stay apart. Null and empty texts are alike to nothing; an empty table gives an empty one."""
    named = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    groups = jaccard.group_documents(named, size=5, percent=80, key="rid").select("rid", "component_id")
    linked = through_table(groups.where("component_id <> rid").unionByName(groups.where("component_id <> rid").select(F.col("component_id").alias("rid"), "component_id")).distinct(), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("rid").alias("c"))
    first = named.select("rid", "doc_id").join(linked, "rid").groupBy("component_id").agg(F.min(order)["c"].alias("first"))
    later = linked.join(first, "component_id").where("rid <> first").select("rid", F.lit(True).alias("later"))
    again = named.select("rid").groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rid", F.lit(False).alias("later"))
    flags = through_table(later.unionByName(again).groupBy("rid").agg(F.max("later").alias("later")), "flags")
    rows = _identified(docs).join(flags, "rid", "left").where("later is null or not later")
    one = rows.where("later is not null").groupBy("rid").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.where("later is null").select("row").unionByName(one.select("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds an item of the benchmark, but for a tenth of its characters, go; rows with the same doc_id and another text stay, and so do null and empty texts. An empty table gives an empty one."""
    named = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text")
    found = through_table(decontam.find_items(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="rid").select("rid").distinct(), "held")
    return _identified(docs).join(found, "rid", "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of each text, drawn without replacement: a row for each, with its ids. A null or empty text, and one that can be cut in one way only, has one. Rows that repeat key and text repeat their samples; an empty table gives an empty one. Other columns are not read."""
    return sampling.sample_segmentations(docs, Vocabulary.read(PIECES).zipf())


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_alike),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: Learned rules and sampled ids have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
