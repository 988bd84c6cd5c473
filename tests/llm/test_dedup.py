import random
from collections import Counter

import numpy as np
import pytest
from common import empty_documents, lower_words, odd_documents

from siltstream.llm import jaccard, linededup


def plain_line_copies(docs):
    """(key, line): whether it is near only, of every line that goes; all earlier lines are looked at."""
    lines, gone = [], {}
    for key, text in sorted(docs, key=lambda d: d[0]):
        for n, line in enumerate((text or "").split("\n")):
            w = lower_words(line)
            if len(w) >= linededup.MIN_WORDS:
                equal = any(w == x for x in lines)
                near = any(max(len(w), len(x)) >= linededup.NEAR_WORDS and linededup.word_distance(w, x, 1) <= 1 for x in lines)
                if equal or near:
                    gone[key, n] = not equal
                lines.append(w)
    return gone


def line_documents(seed):
    r = random.Random(seed)
    base = [[r.choice("abcdefg") for _ in range(n)] for n in (4, 5, 8, 9, 10, 11, 12, 20, 30) for _ in range(4)]
    docs = []
    for i in range(110):
        lines = []
        for _ in range(r.randrange(5)):
            w = list(r.choice(base))
            for _ in range(r.randrange(3)):
                k, c = r.randrange(len(w)), r.random()
                if c < 0.3:
                    w[k] = r.choice("abcdefgH")
                elif c < 0.5 and len(w) > 1:
                    del w[k]
                elif c < 0.7:
                    w.insert(k, r.choice("abcdefg"))
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines) if lines or i % 2 else None))
    return docs


def test_lines_that_go(spark):
    docs = line_documents(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = plain_line_copies(docs)
    assert {(x.key, x.number): x.near for x in linededup.find_copies(df).collect()} == expected
    assert any(expected.values()) and not all(expected.values())
    texts = {x.doc_id: x.text for x in linededup.dedup_lines(df).collect()}
    for i, t in docs:
        assert texts[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in expected))


def test_short_lines_that_are_equal_go(spark):
    docs = [(1, "All rights reserved.\n\nyes"), (2, "all  rights RESERVED.\n\nno"), (3, "yes\nall rights\n \n")]
    got = linededup.find_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(x.key, x.number, x.near) for x in got} == {(2, 0, False), (3, 0, False)}


def test_short_lines_one_word_apart_go(spark):
    docs = [(1, "please read the terms first\nfour words stand here"), (2, "please read our terms first\nfour words stood here"), (3, "please read the terms\nplease read all the terms first")]
    got = linededup.find_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(x.key, x.number, x.near) for x in got} == {(2, 0, True), (3, 0, True), (3, 1, True)}


def test_rows_that_repeat_are_one_document(spark):
    rows = [(1, "one two three\none two three")] * 3 + [(None, "x y z\nq")] * 4 + [(2, "x y z\none two three")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text, r._ld_lines, r._ld_equal, r._ld_near) for r in got} == {(1, "one two three", 2, 1, 0), (None, "x y z\nq", 2, 0, 0), (2, "", 2, 2, 0)}
    assert len(got) == 8


def test_word_distance():
    r = random.Random(4)

    def full(a, b):
        d = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            p, d = d, np.array([i] + [0] * len(b))
            for j, y in enumerate(b, 1):
                d[j] = min(p[j - 1] + (x != y), p[j] + 1, d[j - 1] + 1)
        return int(d[-1])

    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randrange(8))] for _ in range(2))
        for most in (0, 1, 2, 3):
            assert linededup.word_distance(a, b, most) == min(full(a, b), most + 1)


def test_line_dedup_of_odd_and_empty_tables(spark):
    df = odd_documents(spark)
    out = linededup.dedup_lines(df)
    assert out.columns[: len(df.columns)] == df.columns and out.count() == df.count()
    one = out.where("doc_id = 11 or doc_id = 1011").collect()
    assert {(r.doc_id, r.text) for r in one if r.doc_id == 1011} == {(1011, "")}
    assert linededup.dedup_lines(empty_documents(spark)).count() == 0


def sets_of(docs, size):
    out = []
    for _, text in docs:
        w = lower_words(text)
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def plain_components(docs, size, percent):
    """By document: (set size, least key reachable), with every pair that shares a shingle compared."""
    sets, of = sets_of(docs, size), list(range(len(docs)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in by.get(g, ())).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                of[max(a, b)] = min(a, b)
        for g in s:
            by.setdefault(g, []).append(i)
    return {docs[i][0]: (len(sets[i]), docs[root(i)][0]) for i in range(len(docs))}


def similar_documents(seed, n):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnop") for _ in range(r.choice([1, 3, 4, 10, 40, 60, 100]))] for _ in range(40)]
    docs = []
    for i in range(n):
        w = list(r.choice(base[:25] if i % 3 else base[:2]))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice("abcdefghijklmnoP")
        docs.append((i, " ".join(w)))
    return [*docs, (n, None), (n + 1, ""), (n + 2, " \n")]


@pytest.mark.parametrize(("local", "rounds", "size", "percent"), [(1000, 12, 4, 85), (20, 12, 4, 85), (15, 0, 5, 80)])
def test_components_are_exact(spark, monkeypatch, local, rounds, size, percent):
    """Also where regions are parted by pivots, and joined in blocks."""
    monkeypatch.setattr(jaccard, "LOCAL", local)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    docs = similar_documents(local % 97, 400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.group_documents(df, size, percent).collect()}
    assert got == plain_components(docs, size, percent)


def test_a_large_region_of_unlike_documents_is_parted(spark, monkeypatch):
    """Thousands of documents put together from the same passages: each is unlike nearly all others, and all their shingles are frequent."""
    monkeypatch.setattr(jaccard, "LOCAL", 300)
    pairs = []
    blocks = jaccard._join_blocks

    def counted(rows, sets, percent):
        pairs.append(rows.count())
        return blocks(rows, sets, percent)

    monkeypatch.setattr(jaccard, "_join_blocks", counted)
    r = random.Random(12)
    passages = [" ".join(f"p{i}w{k}" for k in range(12)) for i in range(40)]
    docs = []
    for i in range(4000):
        if i % 10 == 9:  # a near copy of an earlier one
            w = docs[r.randrange(i)][1].split()
            w[r.randrange(len(w))] = "other"
            docs.append((i, " ".join(w)))
        else:
            docs.append((i, " ".join(passages[k] for k in [0, *r.sample(range(1, 40), 8)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.group_documents(df).collect()}
    assert got == plain_components(docs, 4, 85)
    assert sum(pairs) == 0  # nothing was left for blocks


def test_regions_of_unlike_sets_are_joined_exactly():
    """One region of documents at all distances, some in a chain of links."""
    r = random.Random(9)
    for percent in (85, 60):
        base = list(range(60))
        sets = []
        for i in range(220):
            s = set(base) if i % 2 else {r.randrange(400) for _ in range(r.randrange(2, 60))}
            for _ in range(r.randrange(12)):
                s.discard(r.choice(sorted(s)))
                s.add(r.randrange(400))
            sets.append(np.array(sorted(s), np.uint64))
        got = jaccard.Forest(len(sets))
        jaccard.join_region(jaccard.Sets(np.arange(len(sets)), sets, percent), np.arange(len(sets)), got)
        expected = jaccard.Forest(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if jaccard.linked(both, len(sets[i]), len(sets[j]), percent):
                    expected.join(i, j)
        assert [got.root(i) for i in range(len(sets))] == [expected.root(i) for i in range(len(sets))]
        assert 1 < len({expected.root(i) for i in range(len(sets))}) < len(sets)


def test_keys_of_any_type(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [("b", long), ("a", long + " x"), ("c", "other words that stand alone here"), (None, long), ("d", long)]
    got = jaccard.group_documents(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(x.doc_id, x.class_id, x.component_id) for x in got} == {("a", "a", "a"), ("b", "b", "a"), ("d", "b", "a"), ("c", "c", "c"), (None, None, None)}


def test_rows_with_one_key_are_one_document(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = [(5, long), (5, "quite another text of some words"), (9, "quite another text of some words"), (7, long + " more"), (None, long)]
    got = jaccard.group_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (9, 5), (7, 5), (None, None)}


def test_jaccard_join_of_odd_and_empty_tables(spark):
    df = odd_documents(spark)
    got = jaccard.group_documents(df)
    assert got.count() == df.count()
    assert {r.component_id for r in got.where("n_shingles = 0 and doc_id is not null").collect()} >= {0, 1, 1000, 1001}
    assert got.where("doc_id = 1009").first().component_id == 9
    assert jaccard.group_documents(empty_documents(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).selectExpr("id AS x", "id - 1 AS y").unionByName(spark.sql("SELECT 1001L AS x, 1000L AS y"))
    got = {r.node: r.component for r in jaccard.components(links).collect()}
    assert got == {i: 0 for i in range(1, 200)} | {1001: 1000}
