import collections
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from common import ODD, empty_documents, odd_documents

from siltstream.llm import sampling, tokencount
from siltstream.llm._bytes import chunks
from siltstream.llm._pieces import MARK, Automaton, Vocabulary, marked

SMALL = Vocabulary({1: b" a", 2: b" ", 3: b"a", 4: b"b", 5: b"ab", 6: b"ba", 7: b"aba"}, {1: -1.0, 2: -2.0, 3: -1.5, 4: -1.2, 5: -2.0, 6: -2.2, 7: -4.0}, {b: 100 + b for b in range(256)})


def fields(data):
    i = 0

    def number():
        nonlocal i
        v = s = 0
        while True:
            c = data[i]
            i += 1
            v |= (c & 127) << s
            s += 7
            if c < 128:
                return v

    while i < len(data):
        k = number()
        if k & 7 == 0:
            yield k >> 3, 0, number()
        else:
            n = number() if k & 7 == 2 else 4 if k & 7 == 5 else 8
            yield k >> 3, k & 7, data[i : i + n]
            i += n


def coded(x):
    out = b""
    while x > 127:
        out += bytes([x & 127 | 128])
        x >>= 7
    return out + bytes([x])


def field(f, w, v):
    return coded(f << 3 | w) + (coded(v) if w == 0 else coded(len(v)) + v if w == 2 else v)


@pytest.fixture(scope="module")
def library():
    """The public encoder with this vocabulary as a unigram model, and our automaton."""
    import sentencepiece

    machine = Automaton(Vocabulary.read(tokencount.PIECES))
    out = b""
    for f, w, v in fields(open(tokencount.PIECES, "rb").read()):
        if f == 1:
            parts = list(fields(v))
            score = next((struct.unpack("<f", x)[0] for g, _, x in parts if g == 2), 0.0)
            rest = b"".join(field(g, k, x) for g, k, x in parts if g not in (2, 3))
            kept = b"".join(field(g, k, x) for g, k, x in parts if g != 2)
            if (1, 2, MARK.encode()) in parts:
                v = kept + field(2, 5, struct.pack("<f", machine.unknown + 10))
            elif score <= -1e8:
                v = rest + field(2, 5, struct.pack("<f", -1.0)) + field(3, 0, 5)
        elif f == 2:
            v = b"".join(field(g, k, 1 if g == 3 else x) for g, k, x in fields(v))
        out += field(f, w, v)
    return sentencepiece.SentencePieceProcessor(model_proto=out), machine


def test_counts_are_the_librarys(spark, library, sf_dir):
    encoder, _ = library
    r = random.Random(1)
    texts = [t for t in ODD if t is not None and len(t) < 1000]
    texts += ["".join(r.choice("aab bc  éß日😀\nthe▁") for _ in range(r.randrange(60))) for _ in range(200)]
    texts += [row.text for row in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_tokens for x in tokencount.count_tokens(df, Vocabulary.read(tokencount.PIECES)).collect()}
    assert [got[i] for i in range(len(texts))] == [len(encoder.encode(t)) for t in texts]


def test_counts_of_long_texts_are_the_librarys(spark, library):
    """Sums far beyond what 32 bits hold, of whole numbers and of fractions."""
    import sentencepiece

    encoder, _ = library
    r = random.Random(8)
    words = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up".split()
    long = [" ".join(r.choice(words) + r.choice(["", "", "s", "ing", ",", ".", "日", "aaa"]) for _ in range(n)) for n in (3000, 20_000)] + ["a" * 20_000, "ab" * 15_000 + "é" * 500]
    vocabulary = Vocabulary.read(tokencount.PIECES)
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {x.doc_id: x.n_tokens for x in tokencount.count_tokens(df, vocabulary).collect()}
    assert [got[i] for i in range(len(long))] == [len(encoder.encode(t)) for t in long]
    # the same pieces with fractions
    logs = {i: float(np.float32(math.log1p(-vocabulary.scores[i]) * -1.37)) for i in vocabulary.pieces}
    out, number = b"", 0
    for f, w, v in fields(encoder.serialized_model_proto()):
        if f == 1:
            parts = list(fields(v))
            number += 1
            if (i := number - 1) in logs:
                v = b"".join(field(g, k, x) for g, k, x in parts if g != 2) + field(2, 5, struct.pack("<f", logs[i]))
        out += field(f, w, v)
    other = sentencepiece.SentencePieceProcessor(model_proto=out)
    fractions = Vocabulary(vocabulary.pieces, logs, vocabulary.byte_ids)
    got = {x.doc_id: x.n_tokens for x in tokencount.count_tokens(df, fractions).collect()}
    assert [got[i] for i in range(len(long))] == [len(other.encode(t)) for t in long]


def best(text):
    """Plain dynamic programming over characters, by the same rules."""
    data = text.encode()
    unknown = min(SMALL.scores.values()) - 10
    table = {0: (0.0, 0)}
    for end in range(1, len(data) + 1):
        options = []
        for start in range(end):
            if start not in table:
                continue
            part = data[start:end]
            for i, p in SMALL.pieces.items():
                if p == part:
                    options.append((table[start][0] + SMALL.scores[i], table[start][1] + 1))
            try:
                if len(part.decode()) == 1 and part not in SMALL.pieces.values():
                    options.append((table[start][0] + unknown, table[start][1] + len(part)))
            except UnicodeDecodeError:
                pass
        for o in options:
            if end not in table or o[0] > table[end][0]:
                table[end] = o
    return table[len(data)]


def test_ties_and_whole_long_texts(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "b", "ab", " ", "é", "\n"]) for _ in range(r.randrange(1, 40))) for _ in range(150)] + ["ab" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.token_score, x.n_tokens) for x in tokencount.count_tokens(df, SMALL).collect()}
    for i, t in enumerate(texts[:-1]):
        score, n = best(" " + t)
        assert math.isclose(got[i][0], score, rel_tol=1e-9) and got[i][1] == n, t
    assert got[150][1] > 3000


def test_odd_and_empty_tables(spark):
    df = odd_documents(spark)
    got = tokencount.count_tokens(df, Vocabulary.read(tokencount.PIECES))
    assert got.count() == df.count()
    assert {x.n_tokens for x in got.where("doc_id in (0, 1)").collect()} == {0}
    assert tokencount.count_tokens(empty_documents(spark), SMALL).count() == 0
    sampled = sampling.sample_segmentations(df, Vocabulary.read(tokencount.PIECES).zipf())
    assert sampled.where("not round_trip").count() == 0
    assert sampled.where("doc_id = 0").select("sample", "n_pieces", "inclusion").distinct().collect() == [(0, 0, 1.0)]
    assert sampling.sample_segmentations(empty_documents(spark), SMALL).count() == 0


def every(text):
    """All segmentations of a marked text, with log probabilities."""
    data, out = text.encode(), {}
    machine = Automaton(SMALL)

    def go(at, ids, log):
        if at == len(data):
            out[tuple(ids)] = log
            return
        for i, p in SMALL.pieces.items():
            if data.startswith(p, at):
                go(at + len(p), [*ids, i], log + SMALL.scores[i])
        c = data[at:].decode()[0].encode()
        if c not in SMALL.pieces.values():
            go(at + len(c), ids + [SMALL.byte_ids[b] for b in c], log + machine.unknown)

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: v - total for k, v in out.items()}


def drawn(text, keys, k, vocabulary=SMALL):
    machine = Automaton(vocabulary)
    speller = sampling.Speller(machine, vocabulary)
    whole = np.frombuffer(text.encode(), np.uint8)
    data, offsets = np.tile(whole, len(keys)), np.arange(len(keys) + 1) * len(whole)
    for row, found in enumerate(sampling._search(machine, data, offsets, np.asarray(keys, np.uint64), k)):
        ids, bounds, ok = speller.spell(found[0][0], [f[1] for f in found], data, offsets, np.full(len(found), row))
        assert ok.all()
        yield [(tuple(ids[a:b].tolist()), log, value, limit) for a, b, (_, _, log, value, limit) in zip(bounds[:-1], bounds[1:], found, strict=True)]


def test_numbers_are_the_same_without_arrays():
    for parts in ((1, 2, 3), (2**63 + 5, 0, 2**41)):
        assert sampling.uniform1(*parts) == float(sampling.uniform(*parts))


def test_samples_are_drawn_without_replacement_in_proportion():
    text = " abab aé b"
    truth, n, k = every(text), 6000, 3
    firsts, pairs, estimate = collections.Counter(), collections.Counter(), collections.Counter()
    for found in drawn(text, range(n), k):
        assert len({x[0] for x in found}) == k
        assert [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)
        firsts[found[0][0]] += 1
        pairs[found[0][0], found[1][0]] += 1
        for ids, log, _, limit in found:
            assert math.isclose(log, truth[ids], abs_tol=1e-9)
            estimate[ids] += 1 / -math.expm1(-math.exp(log - limit)) / n
    p = {s: math.exp(v) for s, v in truth.items()}
    for s, q in p.items():
        assert abs(firsts[s] / n - q) < 5 * math.sqrt(q / n) + 1e-3
        if q > 0.02:  # weighted by inclusion, each is counted once for a row
            assert abs(estimate[s] - 1) < 0.15
    for (a, b), c in pairs.most_common(8):
        q = p[a] * p[b] / (1 - p[a])
        assert abs(c / n - q) < 5 * math.sqrt(q / n) + 1e-3


@pytest.mark.parametrize("text", ["", " a", " ab", " b", " aab é"])
def test_all_segmentations_are_found_when_there_are_few(text):
    (found,) = drawn(text, [5], 60)
    assert {x[0] for x in found} == set(every(text) if text else {()})
    assert len(found) == len({x[0] for x in found})


@pytest.mark.parametrize("score", [-10.0, -20.0, -60.0, -400.0, -900.0])
@pytest.mark.parametrize(("text", "ways"), [(" ab", 2), (" ab ab", 4), (" ab ab ab ab", 16)])
def test_no_segmentation_is_lost_because_it_is_unlikely(score, text, ways):
    vocabulary = Vocabulary({1: b" ", 2: b"a", 3: b"b", 4: b"ab"}, {1: -1.0, 2: score, 3: score, 4: -1.0}, {b: 100 + b for b in range(256)})
    for key in range(20):
        (found,) = drawn(text, [key], 40, vocabulary)
        assert len(found) == ways == len({x[0] for x in found})
        assert [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)
        assert {x[3] for x in found} == {-np.inf}


def test_samples_depend_on_the_row_alone(spark):
    rows = [(i, f"abab ba ab {'ab ' * (i % 5)}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = sampling.sample_segmentations(df.repartition(7), SMALL, 4).orderBy("doc_id", "sample").collect()
    b = sampling.sample_segmentations(df.coalesce(1), SMALL, 4).orderBy("doc_id", "sample").collect()
    assert a == b
    decoder = sampling.Decoder(Automaton(SMALL), SMALL)
    assert all(decoder.text(r.ids) == rows[r.doc_id][1] for r in a)


def test_cutting_units_keeps_texts_whole():
    machine = Automaton(SMALL)
    for _, data, offsets in chunks(marked(pa.array(["ab a", None, "é\nb"]))):
        start, end, bounds = machine.units(data, offsets)
        assert b"".join(data[a:b].tobytes() for a, b in zip(start, end, strict=True)) == data.tobytes()
        assert bounds[1] == bounds[2]
