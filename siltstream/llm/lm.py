"""Language-model scoring: an interpolated modified Kneser-Ney model of any order from 2.

Spark counts the words, then the pairs, then the longer n-grams of all training texts; the
counts lie as sorted hash arrays in the shared folder, and the workers that score texts
memory-map them.

* Level 1 has an entry for each word (its 64-bit hash), for the end of a text and for its
  beginning: how often it occurs, how many different words it follows (its continuation
  count), and as a context: what follows it, and the weight it leaves to level 1.
* Level k has an entry for each n-gram of k words: key = mix64(place of its first k - 1 words
  << 32 | place of its last k - 1), a bijection, so that n-grams are exact and yet fall evenly
  into the shards. All levels but the last also hold the continuation count and the context.
* Counting goes up level by level, adding up goes down: a level's continuation counts are
  known when the level above is counted, and only they give the level below its contexts.

Each map task sends a hash range's counts as one packed row, already summed over its
texts; so a word that makes up a third of the corpus is one number for each task.

Probabilities (Chen and Goodman, "An empirical study of smoothing techniques", 1998), with
A for the number of different pairs, V for the distinct tokens, D for the discount of a count
(of 1, of 2, of 3 or more, by level), and a for the count at the last level, elsewhere for the
continuation count (for an n-gram at a text's beginning, before which nothing stands, the count):
  p1(w) = max(a(w) - D(a), 0) / A + g1 / (V + 1),              g1 = sum of discounts / A
  pk(w|vx) = max(a(vxw) - D(a), 0) / a(vx.) + g(vx) * p(w|x),  g(vx) = sum of vx's discounts / a(vx.)
One beginning stands before a text, so its first token has a context of one. A context that
training never saw leaves the shorter one's. Over the V tokens and one unknown they sum to 1.

Defined results: a null text or an empty one has one token, its end. A null doc_id counts as
an empty one (its crc32 is 0: training). Repeated rows count as often as they stand there. No
training text at all: every token has probability 1 / (V + 1) with V = 0. A text of any length is
scored whole, in memory that grows with its own length. Nothing is chosen, so there are no ties. An empty table gives
an empty one. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, U64, Words, chunks, count_unique, mix64, small_batches, unmix64
from ._shared import HashArrays, begin_stage, by_shard, coded, give_back, inner_folder, pack, release_shuffles, shared_folder, shards_for, sizes_of, text_bytes, unpack, write_shard

END, BEGIN = (int(x) for x in mix64(np.array([1, 2], U64)))
BLOBS = "shard int, blob binary"
#: Bytes of text that are worked on at once.
CHUNK = 1 << 20
#: Distinct keys that a map task holds before it sends them off.
HELD = 1_000_000
#: Keys of one shard that are held before they are added up.
MERGED = 1_000_000
#: Words whose sums one task adds up.
WORDS = 100_000
#: What a context has in all and what it leaves have few different pairs: these are a table.
LEVEL1 = {"count": "u8", "after": "u8", "context": "u8", "total": "context:u8", "left": "context:f8"}
LEVEL2 = {"count": "u8"}
MIDDLE = LEVEL1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of a chunk's texts, an end after each text, and the bounds of each text in them."""
    words = Words(LOWER[data], offsets)
    sizes = words.counts + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(bounds[-1], END, U64)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = words.hashes()
    return out, bounds


def _summed(batches: Iterator[pa.RecordBatch], keys_of, shards: int) -> Iterator[pa.RecordBatch]:
    """Packed (key, count) rows by shard, of keys_of(token hashes, bounds) for each chunk."""
    held, size = [], 0
    begin_stage("counts of language models")

    def send():
        keys, counts = count_unique(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        rows = by_shard(shards, keys, counts.astype(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["shard", "blob"])

    for batch in small_batches(batches, CHUNK):
        for _, data, offsets in chunks(batch.column(0), CHUNK):
            keys, counts = count_unique(keys_of(*tokens(data, offsets)))
            held.append((keys, counts))
            size += len(keys)
            if size > HELD:
                yield send()
                held, size = [], 0
                give_back()
    if held:
        yield send()


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard's blobs, added up a few at a time, so that what is held is little more than the sum."""
    held, size, room = [], 0, MERGED
    for blob in table["blob"]:
        held.append(unpack(blob.as_py(), "u8", "u8"))
        size += len(held[-1][0])
        if size > room:
            held = [count_unique(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            give_back()
            size = len(held[0][0])
            room = max(MERGED, 2 * size)
    return count_unique(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _lookup(level: HashArrays, keys: np.ndarray, *names: str, missing=0) -> list[np.ndarray]:
    """HashArrays.find for keys in any order, with repeats."""
    distinct, back = np.unique(keys, return_inverse=True)
    return [x[back] for x in level.find(distinct, *names, missing=missing)]


class Place:
    """Numbers words without gaps by their place in level 1's shards."""

    def __init__(self, sizes: list[int]):
        self.base = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])

    def number(self, at: np.ndarray) -> np.ndarray:
        return self.base[at >> 40] + (at & ((1 << 40) - 1))


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from how many keys have the counts 1 to 4; where one of these is none, the plain 0.5, 1 and 1.5."""
    if min(n) <= 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [float(min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1)) for k in range(3)]


def _discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)], 0.0)


def _sizes(rows, shards: int) -> list[int]:
    sizes = sizes_of(rows, shards)
    if sum(sizes) >= 1 << 32:
        raise ValueError("a level of 2**32 entries or more has no room in a key's 64 bits")
    return sizes


def _numbers(t: np.ndarray, bounds: np.ndarray, uri: str, sizes: list[list[int]], level: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the level's n-grams that end at a training text's tokens, and where these end."""
    one, place = HashArrays.at(f"{uri}/1", sizes[0], LEVEL1), Place(sizes[0])
    begin = place.number(one.find(np.array([BEGIN], U64), "at")[1])
    now = place.number(_lookup(one, t, "at")[1])
    before = np.concatenate([begin, now[:-1]])
    before[bounds[:-1]] = begin
    keys, on = mix64(before.astype(U64) << U64(32) | now.astype(U64)), np.arange(len(t))
    starts = np.repeat(bounds[:-1], np.diff(bounds))
    for k in range(3, level + 1):
        number = np.full(len(t), -1)
        number[on] = Place(sizes[k - 2]).number(_lookup(HashArrays.at(f"{uri}/{k - 1}", sizes[k - 2], MIDDLE), keys, "at")[1])
        on = on[on - starts[on] >= k - 2]
        keys = mix64(number[on - 1].astype(U64) << U64(32) | number[on].astype(U64))
    return keys, on


def _count_level(texts: DataFrame, uri: str, shards: int, sizes: list[list[int]], level: int) -> list:
    """Stores the level's n-grams with their counts; of each shard: how many there are, and how many have the counts 1 to 4."""

    def grams(batches):
        return _summed(batches, lambda t, bounds: _numbers(t, bounds, uri, sizes, level)[0], shards)

    def store(key, table):
        keys, counts = _merge(table)
        s = key[0].as_py()
        write_shard(f"{uri}/{level}", s, key=keys, count=counts)
        give_back()
        return pa.table({"shard": pa.array([s], pa.int32()), "n": [len(keys)], "counts": pa.array([[int((counts == k).sum()) for k in (1, 2, 3, 4)]], pa.list_(pa.int64()))})

    return texts.mapInArrow(grams, BLOBS).groupBy("shard").applyInArrow(store, "shard int, n long, counts array<long>").collect()  # a row for each shard


def _sum_level(spark, uri: str, shards: int, sizes: list[list[int]], level: int, counted: str, d: list[float]) -> list[int]:
    """Adds the level's counts up for the level below: its continuation counts ("after"; the count, where nothing stands before) and what it is as a context. How many of those are 1, 2, 3, 4, 3 or more, and their sum."""
    place = Place(sizes[level - 2])
    groups = np.arange(shards) * min(shards, -(-sum(sizes[level - 2]) // WORDS)) // shards  # of the lower level's shards, whose sums are added by one task
    edges1 = np.append(np.flatnonzero(np.diff(groups, prepend=-1)), shards)
    types = LEVEL2 | {"after": "u8"}

    def sums(batches):
        for batch in batches:
            for s in batch.column(0).to_pylist():
                level_ = HashArrays(f"{uri}/{level}", sizes[level - 1], types)
                gram, counts = unmix64(level_.column(s, "key")), level_.column(s, counted).astype(np.uint64)
                first = count_unique((gram >> U64(32)).astype(np.int64), counts, *((counts == k).astype(np.uint64) for k in (1, 2)), np.ones(len(gram), np.uint64))
                second = count_unique((gram & U64(0xFFFFFFFF)).astype(np.int64))
                out = {"shard": [], "what": [], "blob": []}
                for what, (numbers, *columns) in (("first", first), ("second", second)):
                    edges = np.searchsorted(numbers, place.base[edges1])
                    for g in np.flatnonzero(np.diff(edges)):
                        a, b = edges[g], edges[g + 1]
                        out["shard"].append(int(g))
                        out["what"].append(what)
                        out["blob"].append(pack_columns((numbers[a:b] - place.base[edges1[g]]).astype(U64), *(c[a:b] for c in columns)))
                del gram, counts, first, second, columns, numbers
                give_back()
                yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), pa.array(out["what"], pa.string()), pa.array(out["blob"], pa.binary())], ["shard", "what", "blob"])

    def store_contexts(key, table):
        first, last = edges1[key[0].as_py()], edges1[key[0].as_py() + 1]
        base = place.base[first : last + 1] - place.base[first]
        n = int(base[-1])
        after, total, n1, n2, all_ = (np.zeros(n, np.uint64) for _ in range(5))
        for what, blob in zip(table["what"].to_pylist(), table["blob"].to_pylist(), strict=True):
            if what == "second":
                at, a = unpack(blob, "u8", "u8")
                after[at.astype(np.int64)] += a
            else:
                at, *columns = unpack(blob, "u8", "u8", "u8", "u8", "u8")
                for to, c in zip((total, n1, n2, all_), columns, strict=True):
                    to[at.astype(np.int64)] += c
        lost = d[0] * n1 + d[1] * n2 + d[2] * (all_ - n1 - n2)
        left = lost / np.maximum(total, 1)
        lower = HashArrays(f"{uri}/{level - 1}", sizes[level - 2], LEVEL1)
        if level > 2:  # an n-gram that begins a text
            count = np.concatenate([lower.column(s, "count") for s in range(first, last)])
            after = np.where(after > 0, after, count)
        for s, a, b in zip(range(first, last), base[:-1], base[1:], strict=True):
            codes, (totals, lefts) = coded(total[a:b], left[a:b])
            write_shard(f"{uri}/{level - 1}", s, ("total", "left"), after=after[a:b], context=codes, total=totals, left=lefts)
        return pa.table({"n": pa.array([[int((after == k).sum()) for k in (1, 2, 3, 4)] + [int((after >= 3).sum()), int(after.sum())]], pa.list_(pa.int64()))})

    found = spark.range(0, shards, 1, shards).mapInArrow(sums, "shard int, what string, blob binary")
    n = found.groupBy("shard").applyInArrow(store_contexts, "n array<long>").agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(6))).first()
    return [x or 0 for x in n]


class KneserNey:
    """fit() counts and stores; score() adds a text's log10 probabilities."""

    def __init__(self, uri: str, sizes: list[list[int]], n_tokens: int, n_distinct: int, n_pairs: int, d: list[list[float]], left1: float):
        """sizes and d (discounts) by level, level 1 first."""
        self.uri, self.sizes = uri, sizes
        self.n_tokens, self.n_distinct, self.n_pairs, self.d, self.left1 = n_tokens, n_distinct, n_pairs, d, left1

    @property
    def order(self) -> int:
        return len(self.d)

    @classmethod
    def fit(cls, texts: DataFrame, text: str = "text", order: int = 2) -> "KneserNey":
        if order < 2:
            raise ValueError("a model has two levels at least")
        spark = texts.sparkSession
        texts = texts.select(F.col(text).cast("string").alias("text"))
        size = text_bytes(texts)
        uri, shards = shared_folder(spark, "lm"), 2 * shards_for(spark, size)

        def words(batches):
            begun = False
            for out in _summed(batches, lambda t, b: t, shards):
                begun = True
                yield out
            if begun:  # the beginning is no token, but has a place
                rows = by_shard(shards, np.array([BEGIN], U64), np.zeros(1, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["shard", "blob"])

        def store_words(key, table):
            keys, counts = _merge(table)
            s = key[0].as_py()
            write_shard(f"{uri}/1", s, key=keys, count=counts)
            return pa.table({"shard": pa.array([s], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())], "distinct": [int((counts > 0).sum())]})

        for level in range(1, order + 1):
            inner_folder(spark, f"{uri}/{level}")
        rows = texts.mapInArrow(words, BLOBS).groupBy("shard").applyInArrow(store_words, "shard int, n long, tokens long, distinct long").collect()  # a row for each shard
        n_tokens, n_distinct = sum(r.tokens for r in rows), sum(r.distinct for r in rows)
        sizes = [_sizes(rows, shards)]
        for level in range(2, order + 1):
            rows = _count_level(texts, uri, shards, sizes, level)
            sizes.append(_sizes(rows, shards))
            release_shuffles(spark, size)  # the level's arrays hold what its shuffle carried
        d = [[0.0] * 3] * order
        d[-1] = discounts([sum(r.counts[k] for r in rows) for k in range(4)])
        for level in range(order, 1, -1):
            n = _sum_level(spark, uri, shards, sizes, level, "count" if level == order else "after", d[level - 1])
            d[level - 2] = discounts(n[:4])
            release_shuffles(spark, size)
        n_pairs = n[5]
        left1 = (d[0][0] * n[0] + d[0][1] * n[1] + d[0][2] * n[4]) / n_pairs if n_pairs else 1.0
        return cls(uri, sizes, n_tokens, n_distinct, n_pairs, d, left1)

    def score_tokens(self, t: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The training count and the model's log10 probability of each token."""
        one = HashArrays.at(f"{self.uri}/1", self.sizes[0], LEVEL1)
        place = Place(self.sizes[0])
        if not self.n_tokens:
            return np.zeros(len(t), np.uint64), np.full(len(t), -np.log10(self.n_distinct + 1))
        distinct, back = np.unique(np.append(t, U64(BEGIN)), return_inverse=True)
        known, count, after, total, left, at = one.find(distinct, "count", "after", "total", "left", "at")
        p1 = _discounted(after, self.d[0]) / max(self.n_pairs, 1) + self.left1 / (self.n_distinct + 1)
        number = np.where(known, place.number(at), -1)
        now, begin = back[:-1], back[-1]
        before = np.concatenate([[begin], now[:-1]])
        before[bounds[:-1]] = begin
        p, count = p1[now], count[now]
        first, second, total, left = number[before], number[now], total[before], left[before]
        for level in range(2, self.order + 1):
            on = np.flatnonzero((first >= 0) & (total > 0))
            key = mix64(first[on].astype(U64) << U64(32) | np.maximum(second[on], 0).astype(U64))
            top = level == self.order
            names = ("count",) if top else ("after", "total", "left", "at")
            found, seen, *more = _lookup(HashArrays.at(f"{self.uri}/{level}", self.sizes[level - 1], LEVEL2 if top else MIDDLE), key, *names)
            found &= second[on] >= 0
            p[on] = _discounted(np.where(found, seen, 0).astype(np.float64), self.d[level - 1]) / total[on] + left[on] * p[on]
            if top:
                break
            second, ctotal, cleft = np.full(len(t), -1), np.zeros(len(t)), np.zeros(len(t))
            ok = on[found]
            second[ok], ctotal[ok], cleft[ok] = Place(self.sizes[level - 1]).number(more[2][found]), more[0][found], more[1][found]
            first, total, left = (np.concatenate([[x], y[:-1]]) for x, y in ((-1, second), (0, ctotal), (0, cleft)))
            first[bounds[:-1]] = -1  # nothing stands before the beginning
        return count, np.log10(p)

    def score(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The columns `keep`, n_tokens, n_known, base_score (add-one unigrams) and score for each row."""
        model = self
        schema = docs.select(*keep).schema
        out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "n_tokens long, n_known long, base_score double, score double"])

        def scored(batches):
            begin_stage(model.uri)
            for batch in small_batches(batches, CHUNK):
                texts = batch.column(0)
                for first, data, offsets in chunks(texts, CHUNK):
                    t, bounds = tokens(data, offsets)
                    counts, logs = model.score_tokens(t, bounds)
                    base = np.log10((counts + 1.0) / (model.n_tokens + model.n_distinct + 1.0))
                    rows = batch.slice(first, len(offsets) - 1)
                    sums = [pa.array(np.diff(bounds)), *(pa.array(np.add.reduceat(x, bounds[:-1])) for x in ((counts > 0).astype(np.int64), base, logs))]
                    yield pa.RecordBatch.from_arrays([*rows.columns[1:], *sums], [*rows.schema.names[1:], "n_tokens", "n_known", "base_score", "score"])

        return docs.select(F.col(text).cast("string").alias("_text"), *keep).mapInArrow(scored, out)


def pack_columns(*arrays: np.ndarray) -> bytes:
    return pack(*(a.astype(np.uint64) for a in arrays))


def held_out(key: Column, every: int = 7, rest: int = 2) -> Column:
    """Whether a row is kept from training: crc32 of its key as text, modulo `every`, is `rest`."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % every == rest


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """Scores every row of docs by a model (of n-grams of `order` words) of those that are not held out: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("held_out", held_out(F.col("key")))
    model = KneserNey.fit(docs.where(~F.col("held_out")), order=order)
    return model.score(docs, keep=("key", "held_out")).select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=3)
