import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F
from common import empty_documents, lower_words, odd_documents

from siltstream.llm import lm
from siltstream.llm._bytes import Words, chunks, mix64, unmix64
from siltstream.llm._shared import by_shard, pack, shard_column, shard_starts, unpack

#: No text has these words.
BEGIN, END = ("begin",), ("end",)


def plain(docs):
    """The model of the module's docstring, word by word."""
    tokens = {i: [*lower_words(t), END] for i, t in docs}
    train = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    pairs = Counter((a, b) for i in train for a, b in zip([BEGIN, *tokens[i]], tokens[i], strict=False))
    after, total = Counter(b for _, b in pairs), Counter()
    kinds = [Counter(), Counter(), Counter()]
    for (a, _), k in pairs.items():
        total[a] += k
        kinds[min(k, 3) - 1][a] += 1
    d2, d1 = (lm.discounts([sum(x == k for x in counts.values()) for k in (1, 2, 3, 4)]) for counts in (pairs, after))
    less = lambda k, d: d[min(k, 3) - 1] if k else 0
    left = sum(less(k, d1) for k in after.values()) / len(pairs) if pairs else 1.0

    def p1(w):
        return (max(after[w] - less(after[w], d1), 0) / len(pairs) if pairs else 0) + left / (v + 1)

    def p(a, b):
        if not total[a]:
            return p1(b)
        return max(pairs[a, b] - less(pairs[a, b], d2), 0) / total[a] + sum(d * k[a] for d, k in zip(d2, kinds, strict=True)) / total[a] * p1(b)

    out = {}
    for i, t in tokens.items():
        out[i] = (len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(a, b)) for a, b in zip([BEGIN, *t], t, strict=False)))
    known = [*c, ("unknown",)]
    return out, [sum(p(a, w) for w in known) for a in [BEGIN, *list(c)[:20]]]


def check(spark, docs):
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    expected, sums = plain(docs)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    for i, (n, known, train, base, score) in expected.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_scores_are_those_of_the_plain_model(spark):
    r = random.Random(1)
    vocabulary = ["a", "B", "c", "dé", "E!", "f", "<s>", "</s>"]
    docs = [(i, " ".join(r.choices(vocabulary, weights=range(1, 9), k=r.randrange(40)))) for i in range(60)] + [(60, None), (61, "never seen"), (-5, "a\tb\vc")]
    check(spark, docs)


def plain_scores(docs, order):
    """Scores by n-grams of up to `order` words, level by level; one beginning stands before each text."""
    tokens = {i: [BEGIN, *lower_words(t), END] for i, t in docs}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    raw = {k: Counter(tuple(t[j : j + k]) for t in train for j in range(len(t) - k + 1)) for k in range(1, order + 1)}
    counts = {order: raw[order]}
    for k in range(1, order):
        after = Counter(g[1:] for g in raw[k + 1])
        counts[k] = {g: after[g] or raw[k][g] for g in raw[k] if k > 1 or g != (BEGIN,)}
    d = {k: lm.discounts([sum(x == n for x in c.values()) for n in (1, 2, 3, 4)]) for k, c in counts.items()}
    less = lambda k, n: d[k][min(n, 3) - 1] if n else 0
    followers = {k: {} for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            followers[k].setdefault(g[:-1], []).append(n)
    v = len(counts[1])

    def p(context, w):
        k = len(context) + 1
        below = p(context[1:], w) if context else 1 / (v + 1)
        held = followers[k].get(context)
        if not held:
            return below
        n = counts[k].get((*context, w), 0)
        return max(n - less(k, n), 0) / sum(held) + sum(less(k, x) for x in held) / sum(held) * below

    scores = {i: sum(math.log10(p(tuple(t[max(j - order + 1, 0) : j]), t[j])) for j in range(1, len(t))) for i, t in tokens.items()}
    known = [*(g[0] for g in counts[1]), ("unknown",)]
    contexts = [g for k in range(1, order) for g in list(raw[k])[:20]]
    return scores, [sum(p(c, w) for w in known) for c in contexts]


def test_scores_of_longer_ngrams(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choices("abcdef", weights=range(1, 7), k=r.randrange(40)))) for i in range(60)] + [(60, None), (61, "never seen a b c"), (62, "a b c never a b c d")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    by_order = {}
    for order in (3, 4):
        expected, sums = plain_scores(docs, order)
        assert all(abs(s - 1) < 1e-9 for s in sums)
        by_order[order] = {x.doc_id: x.score for x in lm.score_documents(df, order=order).collect()}
        assert by_order[order].keys() == expected.keys()
        assert all(math.isclose(by_order[order][i], s, rel_tol=1e-9) for i, s in expected.items())
    assert by_order[3] != by_order[4]


def test_no_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


def test_no_training_rows_for_longer_ngrams(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), order=3).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


def test_odd_and_empty_tables(spark):
    df = odd_documents(spark)
    assert lm.score_documents(df).count() == df.count()
    assert lm.score_documents(empty_documents(spark)).count() == 0


def test_spark_and_numpy_agree_on_shards(spark):
    edges = np.concatenate([shard_starts(49), shard_starts(49)[1:] - np.uint64(1), np.array([2**64 - 1], np.uint64)])
    df = spark.createDataFrame([(int(x),) for x in edges.view(np.int64)], "k long")
    got = [r[0] for r in df.select(shard_column(F.col("k"), 49)).collect()]
    assert got == (np.searchsorted(shard_starts(49), edges, "right") - 1).tolist()


def test_bytes_and_packing():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    assert (unmix64(mix64(a)) == a).all()
    c = np.arange(len(a), dtype=np.uint32)
    x, y = unpack(pack(a, c), "u8", "u4")
    assert (x == a).all() and (y == c).all()
    parts = by_shard(7, a, c)
    assert (np.concatenate([unpack(b, "u8", "u4")[0] for _, b in parts]) == a).all() and len(parts) == 7
    texts = ["one two\n\nthree", None, "", "\n", "x\ny"]
    for _, data, offsets in chunks(pa.array(texts)):
        w = Words(data, offsets, breaks=10)
        assert w.per_text.tolist() == [3, 1, 1, 2, 2]
        assert w.counts.tolist() == [2, 0, 1, 0, 0, 0, 0, 1, 1]


def test_a_shard_that_is_gone_raises(spark, tmp_path):
    """A reader must not take a file that it can't see for an empty shard."""
    from siltstream.llm import _shared

    keys = np.array([5, 9, 1 << 40], np.uint64)
    _shared.write_shard(str(tmp_path), 0, ("table",), key=keys, n=np.array([1, 300, 2], np.uint64), code=np.array([1, 0, 1], np.uint64), table=np.array([0.5, 7.25]))
    types = {"n": "u8", "code": "u8", "table": "code:f8"}
    found, n, value = _shared.HashArrays(str(tmp_path), [3, 0], types).find(np.array([5, 6, 1 << 40], np.uint64), "n", "table")
    assert found.tolist() == [True, False, True] and n.tolist() == [1, 0, 2] and value.tolist() == [7.25, 0.0, 7.25]
    (tmp_path / "000000.key").unlink()
    with pytest.raises(OSError):
        _shared.HashArrays(str(tmp_path), [3, 0], types).find(keys, "n")
    with pytest.raises(OSError):
        _shared.HashArrays(str(tmp_path), [4, 0], types).column(0, "table"), _shared.HashArrays(str(tmp_path), [4, 0], types).column(0, "n")
