"""The pipeline's stages against plain Python, each on what the stage before it kept."""

import pytest
from common import empty_documents, odd_documents, words
from pyspark.sql import functions as F
from test_dedup import plain_components, plain_line_copies
from test_rules_shards_chat import plain_statistics

import corpus_pipeline
from siltstream.llm import decontam, rules
from siltstream.llm._shared import through_table


def stage(spark, name, docs, sf_dir):
    return through_table(dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir), "test")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """What each stage keeps of the documents table."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, _ in corpus_pipeline.STAGES:
        out.append(stage(spark, name, out[-1], sf_dir))
    return out


def test_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[1:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]


def test_quality_rules(spark, sf_dir, kept):
    before, after = texts(kept[0]), texts(kept[1])
    failed = {i for i, t in before.items() if (s := plain_statistics(t))[0] < 20 or 100 * s[4] > 30 * s[0]}
    counted = through_table(rules.with_statistics(kept[0].select("doc_id", "text")).drop("text"), "test")
    found = rules.fit_rules(counted, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    hit = {r.doc_id for r in counted.where(rules.verdict(found).isNotNull()).collect()} if found else set()
    assert set(after) == set(before) - failed - hit
    assert all(after[i] == before[i] for i in after)


def test_line_dedup(kept):
    before, after = texts(kept[1]), texts(kept[2])
    gone = plain_line_copies(list(before.items()))
    expected = {}
    for i, t in before.items():
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        if left == t or words(left):
            expected[i] = left
    assert after == expected and gone
    assert kept[2].where("n_chars <> length(text)").join(kept[0].where("n_chars = length(text)"), "doc_id").count() == 0


def test_near_duplicates(kept):
    before = texts(kept[2])
    groups = plain_components(sorted(before.items()), 5, 80)
    assert texts(kept[3]) == {i: before[i] for i, (_, of) in groups.items() if of == i}


def test_decontamination(spark, sf_dir, kept):
    before = texts(kept[3])
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {i for i, t in before.items() if any(x in decontam.normal(t) for x in items)}
    after = texts(kept[4])
    assert set(after) <= set(before) - held
    matcher = decontam.Matcher(list(enumerate(items)))
    for i in set(before) - set(after):  # what else went lies within the budget
        assert matcher.find(decontam.normal(before[i]))


def test_encoding(kept):
    rows = kept[5]
    assert rows.where("not round_trip or inclusion <= 0 or inclusion > 1").count() == 0
    assert rows.groupBy("doc_id").count().where("count <> 2").count() == 0
    assert rows.groupBy("doc_id").agg(F.count_distinct("ids_md5").alias("n")).where("n <> 2").count() == 0
    assert rows.select("doc_id").distinct().count() == kept[4].count()


def test_stages_take_odd_and_empty_tables(spark, sf_dir):
    odd, none = odd_documents(spark), empty_documents(spark)
    for name, _ in corpus_pipeline.STAGES:
        out = stage(spark, name, odd, sf_dir)
        assert out.count() <= 2 * odd.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns
        assert stage(spark, name, none, sf_dir).count() == 0


def test_rows_are_told_apart_by_key_and_text(spark, sf_dir):
    """And columns may bear any name."""
    long = " ".join(f"w{i}" for i in range(60))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(5, long, 77), (5, "quite another text " + long[::-1], 78), (9, long + " more", 79), (None, long, 80), (None, long, 81), (7, "x", 82), (7, "x", 83), (3, item, 84), (3, "not that item", 85)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n long").selectExpr("*", "1 AS _held", "2 AS rid", "3 AS row", "4 AS later", "5 AS component_id", "6 AS first")
    alike = corpus_pipeline.keep_one_of_alike(spark, df, sf_dir)
    assert alike.columns == df.columns
    assert sorted(r._n for r in alike.collect()) == [77, 78, 82, 84, 85]
    clean = corpus_pipeline.drop_contaminated(spark, df, sf_dir)
    assert clean.columns == df.columns and sorted(r._n for r in clean.collect()) == [77, 78, 79, 80, 81, 82, 83, 85]
    lines = corpus_pipeline.drop_repeated_lines(spark, df, sf_dir)
    assert lines.columns == df.columns and {r._n for r in lines.collect()} >= {78, 84, 85}


def test_run(spark, sf_dir, kept):
    got = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "sample", "ids_md5"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, kept[5].select(key).collect()))
