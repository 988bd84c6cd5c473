"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly, through the metric.

1 - Jaccard is a metric, so pivots can part it. Document pivots alone can't part a corpus: almost
all distances are exactly 1, so every window would hold everything. So there are two kinds:

1. The first pivots are the single shingles. A set's distance to {s} is 1 - 1/n if it has s, else 1;
   its nearest pivots, all equally near, are its own shingles, and ties are broken one way for
   all sets: the rarer shingle first. A set lies in the cell of its first shingle; if two sets are within
   the bound, at most n * (100 - percent) / 100 of either's shingles are missing from the other,
   so replicating each set to the cells of so many further pivots (its window) makes every
   pair meet. Shingles that no other document has are cells of one: most documents end here.
2. Cells with one least member form a region around it. Inside regions, documents are
   pivots: a set within the bound of the pivot is linked to it; of the others, by the triangle
   inequality, only sets whose distances to the pivot differ by at most the bound can be
   linked; Voronoi regions of several pivots, with boundary sets replicated to every region whose
   pivot is at most twice the bound farther than the nearest, are joined recursively. A small region
   is joined in one task. A large one is parted into such cells by joins, many tasks each: what is linked
   to its cell's pivot leaves, but for those within the window of the others, and the cells are
   regions again. One that document pivots hardly part (its members are all far from each other) is parted by its
   rarest shingles as the corpus was, counted within it; only what neither shrinks is joined in blocks,
   a task for each two. Nothing is left out.

Two sets that are both linked to a pivot are in one component; no more is asked about them. So a group of
thousands of copies costs thousands of distances, not millions.

The shingles' frequencies are counted over all documents, one for each class of equal sets; those that
occur twice or more lie in the shared folder as sorted hash arrays. Shingles are 64-bit hashes.

Defined results: a null or empty text has 0 shingles and is its own component. A text of fewer words than a
shingle is one shingle. A text of any length is read whole, in memory that grows with its own length. Rows with one
key are one document. A row whose key is null is linked with nothing, and its component is null. Keys may be of any
type that can be ordered. Equal sets are one class, named by its least key; of keys equally near nothing is chosen.
An empty table gives an empty one. Further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import LOWER, U64, Words, chunks, count_unique, mix64, sequence_hashes, sequence_sums, small_batches
from ._shared import HashArrays, begin_stage, by_shard, drop_folder, inner_folder, release_shuffles, shards_for, shared_folder, shard_starts, sizes_of, text_bytes, through_table, unpack, write_shard

SIZE, PERCENT = 4, 85
#: Distinct shingles that a map task holds before it sends their counts off.
HELD = 1_500_000
#: Shingles of one shard that are held before they are added up.
MERGED = 2_000_000
#: A region of up to so many documents and bytes of sets is joined by one task.
LOCAL, LOCAL_BYTES = 1000, 16 << 20
#: So many documents are compared pair by pair.
FEW = 24
#: A larger region is parted by so many pivots, so many times at most, and a cut holds if no part has more than this share of the region.
PIVOTS, ROUNDS, SHRUNK = 8, 12, 0.7


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of a chunk's texts, each text's sorted and distinct, and their bounds."""
    words = Words(LOWER[data], offsets)
    n = words.counts
    sums = sequence_sums(words.hashes())
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(words.bounds[:-1], counts) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)
    hashes = sequence_hashes(sums, first, first + np.repeat(np.minimum(n, size), counts))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[bounds[:-1][counts > 0]] = True
    totals = np.concatenate([[0], np.cumsum(new)])
    return hashes[new], totals[bounds]


def _prints(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell a set from others."""
    sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix64(hashes + U64(k)))]) for k in (1, 2)]
    return tuple(s[bounds[1:]] - s[bounds[:-1]] for s in sums)


def _print_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a ^ mix64(b))


def document_table(docs: DataFrame, size: int) -> DataFrame:
    """key, n_shingles, a, b (of the set) for each row."""

    def made(batches):
        begin_stage("shingle sets")
        for batch in small_batches(batches, column=1):
            for first, data, offsets in chunks(batch.column(1)):
                hashes, bounds = shingle_sets(data, offsets, size)
                a, b = _prints(hashes, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), pa.array(np.diff(bounds)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["key", "n_shingles", "a", "b"])

    return docs.mapInArrow(made, "key long, n_shingles long, a long, b long")


class Copies:
    """Tells which rows are copies: they have a class's set, but not its least key."""

    TYPES = {"b": "u8", "least": "i8"}

    def __init__(self, uri: str, sizes: list[int]):
        self.uri, self.sizes = uri, sizes

    def among(self, keys: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        a, b = _prints(hashes, bounds)
        names, back = np.unique(_print_key(a, b), return_inverse=True)
        found, other, least = HashArrays.at(self.uri, self.sizes, self.TYPES).find(names, "b", "least")
        return found[back] & (other[back] == b) & (least[back] != keys)


def _store_copies(table: DataFrame, uri: str, shards: int) -> Copies:
    """Writes the classes of two rows or more."""
    inner_folder(table.sparkSession, uri)

    def store(batches):
        held = defaultdict(list)
        for batch in batches:
            s = np.asarray(batch.column(0))
            for k in np.unique(s):
                held[int(k)].append(batch.filter(pa.array(s == k)))
        for k, parts in held.items():
            t = pa.Table.from_batches(parts)
            a, b, least = (np.asarray(t[c]) for c in ("a", "b", "least"))
            names = _print_key(a.view(U64), b.view(U64))
            names, at = np.unique(names, return_index=True)
            write_shard(uri, k, key=names, b=b.view(U64)[at], least=least[at])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(names)], pa.int64())], ["shard", "n"])

    def keyed(batches):  # the shard of a class follows its mixed name, which only numpy makes
        for batch in batches:
            a, b = (np.asarray(batch.column(k)).view(U64) for k in (0, 1))
            shard = (np.searchsorted(shard_starts(shards), _print_key(a, b), "right") - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], ["shard", "a", "b", "least"])

    classes = table.where("key is not null and n_shingles > 0").groupBy("a", "b").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "least")
    rows = classes.mapInArrow(keyed, "shard int, a long, b long, least long")
    return Copies(uri, sizes_of(rows.repartition(shards, "shard").mapInArrow(store, "shard int, n long").collect(), shards))  # a row for each shard


def _count_shingles(docs: DataFrame, size: int, copies: Copies, uri: str, shards: int) -> list[int]:
    """Stores each shingle of two documents or more with its number of documents (classes of equal sets); how many there are in each shard."""
    inner_folder(docs.sparkSession, uri)

    def counted(batches):
        begin_stage(uri)
        held, n = [], 0

        def send():
            keys, counts = count_unique(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            rows = by_shard(shards, keys, np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["shard", "blob"])

        for batch in small_batches(batches, column=1):
            keys = np.asarray(batch.column(0))
            for first, data, offsets in chunks(batch.column(1)):
                hashes, bounds = shingle_sets(data, offsets, size)
                own = ~copies.among(keys[first : first + len(bounds) - 1], hashes, bounds)
                k, c = count_unique(hashes[np.repeat(own, np.diff(bounds))])
                held.append((k, c))
                n += len(k)
                if n > HELD:
                    yield send()
                    held, n = [], 0
        if held:
            yield send()

    def merged(group, table):
        held, n, room = [], 0, MERGED
        for blob in table["blob"]:
            held.append(unpack(blob.as_py(), "u8", "u4"))
            n += len(held[-1][0])
            if n > room:
                held = [count_unique(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                n = len(held[0][0])
                room = max(MERGED, 2 * n)
        keys, counts = count_unique(*(np.concatenate(x) for x in zip(*held, strict=True)))
        often = counts > 1
        write_shard(uri, group[0].as_py(), key=keys[often], documents=counts[often])
        return pa.table({"shard": pa.array([group[0].as_py()], pa.int32()), "n": pa.array([int(often.sum())], pa.int64())})

    return sizes_of(docs.mapInArrow(counted, "shard int, blob binary").groupBy("shard").applyInArrow(merged, "shard int, n long").collect(), shards)  # a row for each shard


def _candidates(docs: DataFrame, size: int, percent: int, copies: Copies, uri: str, sizes: list[int]) -> DataFrame:
    """Documents that may have a partner: key, n, set (sorted hashes), cells (the window's shingles that others have too)."""

    def made(batches):
        begin_stage(f"{uri} candidates")
        for batch in small_batches(batches, column=1):
            keys = np.asarray(batch.column(0))
            for first, data, offsets in chunks(batch.column(1)):
                hashes, bounds = shingle_sets(data, offsets, size)
                own = ~copies.among(keys[first : first + len(bounds) - 1], hashes, bounds)
                names, back = np.unique(hashes, return_inverse=True)
                _, often = HashArrays.at(uri, sizes, {"documents": "u8"}).find(names, "documents")
                often = often[back]
                n = np.diff(bounds)
                alone = np.diff(np.concatenate([[0], np.cumsum(often == 0)])[bounds])
                window = n * (100 - percent) // 100 + 1 - alone
                out = []
                for i in np.flatnonzero(own & (n > 0) & (window > 0)).tolist():
                    h, o = hashes[bounds[i] : bounds[i + 1]], often[bounds[i] : bounds[i + 1]]
                    order = np.lexsort((h, o))[alone[i] : alone[i] + window[i]]
                    out.append((first + i, len(h), h.tobytes(), h[order].view(np.int64)))
                rows, counts, sets, cells = zip(*out, strict=True) if out else ([], [], [], [])
                at = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32)
                flat = np.concatenate(cells) if cells else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(counts, pa.int64()), pa.array(sets, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["key", "n", "set", "cells"])

    return docs.mapInArrow(made, "key long, n long, set binary, cells array<long>")


# -- inside a region


def linked(both: int, n: int, m: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


class Sets:
    """Some documents' sets end to end."""

    def __init__(self, keys: np.ndarray, sets: list[np.ndarray], percent: int):
        self.keys, self.sets, self.percent = keys, sets, percent
        self.n = np.array([len(s) for s in sets], np.int64)

    def shared(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """How many shingles the pivot shares with each of the others."""
        if not len(others):
            return np.zeros(0, np.int64)
        flat = np.concatenate([self.sets[i] for i in others])
        mine = self.sets[pivot]
        at = np.searchsorted(mine, flat)
        at[at == len(mine)] = 0
        hit = np.concatenate([[0], np.cumsum(mine[at] == flat)])
        ends = np.concatenate([[0], np.cumsum(self.n[others])])
        return hit[ends[1:]] - hit[ends[:-1]]

    def to(self, pivot: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the pivot, and whether within the bound."""
        both = self.shared(pivot, others)
        union = self.n[pivot] + self.n[others] - both
        return 1.0 - both / np.maximum(union, 1), 100 * both >= self.percent * union


class Forest:
    """Components among the documents of one region."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def root(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = self.of[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.of[max(a, b)] = min(a, b)


EPSILON = 1e-9


def join_region(sets: Sets, rows: np.ndarray, forest: Forest, across: np.ndarray | None = None, depth: int = 0) -> None:
    """Joins the components of all links among rows (across: only those between documents of different `across`)."""
    bound = 1.0 - sets.percent / 100.0
    rows = rows[np.argsort(sets.n[rows], kind="stable")]
    if len(rows) <= FEW or depth > 12:
        for i, x in enumerate(rows[:-1].tolist()):
            rest = rows[i + 1 :]
            rest = rest[100 * sets.n[x] >= sets.percent * sets.n[rest]]
            if across is not None:
                rest = rest[across[rest] != across[x]]
            mine = forest.root(x)
            rest = rest[[forest.root(int(y)) != mine for y in rest]] if len(rest) else rest
            _, near = sets.to(x, rest)
            for y in rest[near].tolist():
                forest.join(x, y)
        return
    # the pivots: first one, then whichever is farthest from those that there are
    pivots, distances = [], []
    nearest = np.full(len(rows), np.inf)
    settled = np.zeros(len(rows), bool)
    for _ in range(8):
        at = int(np.argmax(np.where(settled, -1.0, nearest))) if pivots else 0
        if pivots and (settled[at] or nearest[at] <= bound):
            break
        d, near = sets.to(int(rows[at]), rows)
        for y in rows[near].tolist():
            forest.join(int(rows[at]), y)
        pivots.append(at)
        distances.append(d)
        nearest = np.minimum(nearest, d)
        settled[at] = True
    away = np.stack(distances)
    home = np.argmin(away, 0)
    for j in range(len(pivots)):
        # what lies in the region, and what a member of it may be linked with
        inner = home == j
        outer = ~inner & (away[j] <= nearest + 2 * bound + EPSILON)
        free = inner & (away[j] > bound + EPSILON)  # not linked to the pivot
        if not free.any() and not outer.any():
            continue
        part = np.flatnonzero(inner | outer)
        if len(part) < 0.8 * len(rows):
            join_region(sets, rows[part], forest, across, depth + 1)
            continue
        # the region is no smaller: each member against those in its window, by distance to the pivot and by size
        order = part[np.argsort(away[j][part], kind="stable")]
        d, size = away[j][order], sets.n[rows[order]]
        for i, k in enumerate(order.tolist()):
            if not inner[k]:
                continue
            a, b = np.searchsorted(d, d[i] - bound - EPSILON), np.searchsorted(d, d[i] + bound + EPSILON, "right")
            others = order[a:b]
            n = sets.n[rows[k]]
            ok = (100 * size[a:b] >= sets.percent * n) & (100 * n >= sets.percent * size[a:b]) & ((others > k) | ~inner[others])
            if across is not None:
                ok &= across[rows[others]] != across[rows[k]]
            others = others[ok]
            mine = forest.root(int(rows[k]))
            others = others[[forest.root(int(rows[o])) != mine for o in others]] if len(others) else others
            _, near = sets.to(int(rows[k]), rows[others])
            for o in others[near].tolist():
                forest.join(int(rows[k]), int(rows[o]))


def _join_small(regions: DataFrame, percent: int, by: list[str]) -> DataFrame:
    """Links (x to the least of its component) of regions that fit one task. regions: `by`, key, set, side."""

    def joined(group, table):
        keys = np.asarray(table["key"])
        order = np.argsort(keys, kind="stable")
        sets = Sets(keys[order], [np.frombuffer(table["set"][int(i)].as_py(), U64) for i in order], percent)
        side = np.asarray(table["side"])[order]
        forest = Forest(len(order))
        join_region(sets, np.arange(len(order)), forest, side if len(set(side.tolist())) > 1 else None)
        links = [(int(sets.keys[i]), int(sets.keys[r])) for i in range(len(order)) if (r := forest.root(i)) != i]
        return pa.table({"x": pa.array([a for a, _ in links], pa.int64()), "y": pa.array([b for _, b in links], pa.int64())})

    return regions.groupBy(*by).applyInArrow(joined, "x long, y long")


def _salted(rows: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (region, key, count, bytes) in parts of about a task's room by `salt`, and other (region, ...) with each region's rows in each of its parts: so a region of any size is joined by many tasks."""
    parts = F.ceil(F.greatest(F.col("count") / F.lit(LOCAL), F.col("bytes") / F.lit(LOCAL_BYTES))).cast("int")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(3)), parts).cast("int"))
    sizes = rows.select("region", parts.alias("_p")).distinct()
    return rows, other.join(sizes, "region").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).drop("_p")


PLACED = "region long, key long, cell int, pivot long, home boolean, d double, near boolean"


def _place(rows: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Voronoi cells of large regions: PIVOTS members by chance are pivots; each member comes home to its nearest pivot's cell, and once more to every cell whose pivot is at most twice the bound farther."""
    picks = rows.groupBy("region").agg(*(F.min(F.struct(F.xxhash64("key", F.lit(turn * PIVOTS + j)).alias("h"), F.col("key").alias("key")))["key"].alias(f"p{j}") for j in range(PIVOTS)))
    pivots = picks.select("region", F.explode(F.array_distinct(F.array(*(F.col(f"p{j}") for j in range(PIVOTS))))).alias("key"))
    left, right = _salted(rows, pivots)
    left = left.join(sets, "key").select("region", "salt", "key", "set")
    right = right.join(sets, "key").select(*(F.col(c).alias(f"pivot_{c}") for c in ("region", "salt", "key", "set")))
    bound = 1.0 - percent / 100.0

    def placed(members, pivots):
        keys, centres = np.asarray(members["key"]), np.asarray(pivots["pivot_key"])
        order = np.argsort(centres)  # the cells' numbers are the same in every part
        both = Sets(np.concatenate([keys, centres[order]]), [np.frombuffer(x.as_py(), U64) for x in members["set"]] + [np.frombuffer(pivots["pivot_set"][int(i)].as_py(), U64) for i in order], percent)
        n, everyone = len(keys), np.arange(len(keys))
        found = [both.to(n + j, everyone) for j in range(len(centres))]
        away, near = np.stack([d for d, _ in found]), np.stack([x for _, x in found])
        nearest, home = away.min(0), away.argmin(0)
        cell, who = np.nonzero(away <= nearest + 2 * bound + EPSILON)
        region = members["region"][0].as_py() if n else 0
        return pa.table(
            [pa.array(np.full(len(who), region, np.int64)), pa.array(keys[who]), pa.array(cell.astype(np.int32)), pa.array(centres[order][cell]), pa.array(home[who] == cell), pa.array(away[cell, who]), pa.array(near[cell, who])],
            ["region", "key", "cell", "pivot", "home", "d", "near"],
        )

    return left.groupBy("region", "salt").cogroup(right.groupBy("pivot_region", "pivot_salt")).applyInArrow(placed, PLACED)


def _rarest(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Large regions cut as the corpus was: within each, the members' shingles are counted, and a member lies in the cells of its rarest ones, as many as the bound allows to be missing and one. region, parent, key."""
    each = rows.select("region", "key").join(sets, "key")

    def listed(batches):
        for batch in small_batches(batches, column=3):
            lengths = [len(x.as_py()) // 8 for x in batch.column(3)]
            flat = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
            at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["region", "key", "n", "shingles"])

    exploded = each.select("region", "key", "n", "set").mapInArrow(listed, "region long, key long, n long, shingles array<long>").select("region", "key", "n", F.explode("shingles").alias("shingle"))
    counts = exploded.groupBy("region", "shingle").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("least"))
    ranked = exploded.join(counts, ["region", "shingle"]).withColumn("k", F.row_number().over(Window.partitionBy("region", "key").orderBy("c", "shingle")))
    cells = ranked.where(F.col("k") <= F.floor(F.col("n") * (100 - percent) / 100) + 1).where("c > 1")
    return cells.select(F.xxhash64("region", "least").alias("region"), F.col("region").alias("parent"), "key").distinct()


def region_links(candidates: DataFrame, percent: int) -> DataFrame:
    """Links whose components are those of all links among the candidates."""
    spark = candidates.sparkSession
    root = shared_folder(spark, "regions")
    cells = candidates.select("key", F.explode("cells").alias("cell"))
    least = cells.groupBy("cell").agg(F.min("key").alias("region"), F.count(F.lit(1)).alias("c")).where("c > 1").select("cell", "region")
    members = through_table(cells.join(least, "cell").select("region", "key").distinct(), "members", root)
    sets = candidates.select("key", "n", "set")
    weight = candidates.select("key", F.octet_length("set").alias("bytes"))
    bound = 1.0 - percent / 100.0
    links = []
    for turn in range(ROUNDS + 1):
        folder = inner_folder(spark, f"{root}/{turn}")
        sizes = through_table(members.join(weight, "key").groupBy("region").agg(F.count(F.lit(1)).alias("count"), F.sum("bytes").alias("bytes")).where("count > 1"), "sizes", folder)
        small = (F.col("count") <= LOCAL) & (F.col("bytes") <= LOCAL_BYTES)
        few = members.join(sizes.where(small).select("region"), "region").join(sets, "key").select("region", "key", "set", F.lit(0).alias("side"))
        links.append(through_table(_join_small(few, percent, ["region"]), "few", folder))
        large = sizes.where(~small)
        if large.isEmpty():
            break
        rows = members.join(large, "region")
        if turn == ROUNDS:
            links.append(_join_blocks(rows, sets, percent))
            break
        # cells around pivots; what is linked to its cell's pivot leaves, but for the window of those that aren't
        placed = through_table(_place(rows, sets, percent, turn), "placed", folder)
        links.append(placed.where("near and key <> pivot").select(F.col("key").alias("x"), F.col("pivot").alias("y")))
        edge = placed.where("not near").groupBy("region", "cell").agg(F.min("d").alias("edge"))
        left = placed.join(edge, ["region", "cell"]).where(~F.col("near") | (F.col("d") >= F.col("edge") - F.lit(bound + EPSILON)))
        left = through_table(left.select(F.xxhash64("region", "cell", F.lit(turn)).alias("region"), F.col("region").alias("parent"), "key"), "left", folder)
        # a region without anything left is done; one that its pivots hardly part is parted by its rarest shingles, else in blocks
        parted = _shrunk(left, large)
        stalled = large.join(left.select(F.col("parent").alias("region")).distinct(), "region", "left_semi").join(parted, "region", "left_anti")
        rest = members.join(through_table(stalled, "stalled", folder), "region")
        by_shingle = through_table(_rarest(rest, sets, percent), "rarest", folder)
        again = _shrunk(by_shingle, large)
        occupied = by_shingle.select(F.col("parent").alias("region")).distinct()
        links.append(_join_blocks(rest.join(occupied, "region", "left_semi").join(again, "region", "left_anti"), sets, percent))
        kept = [x.join(y.select(F.col("region").alias("parent")), "parent", "left_semi").select("region", "key") for x, y in ((left, parted), (by_shingle, again))]
        members = through_table(kept[0].unionByName(kept[1]).distinct(), "members", folder)
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _shrunk(cut: DataFrame, large: DataFrame) -> DataFrame:
    """The regions (of `large`) whose largest part has at most SHRUNK of their members."""
    parts = cut.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("_n")).groupBy("parent").agg(F.max("_n").alias("_most"))
    return parts.select(F.col("parent").alias("region"), "_most").join(large, "region").where(F.col("_most") <= F.col("count") * SHRUNK).select("region")


def _join_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Regions that pivots don't thin, in blocks of a quarter of a task's room; every two blocks meet in a task of their own."""
    blocks = F.ceil(F.greatest(F.col("count") / F.lit(LOCAL / 4), F.col("bytes") / F.lit(LOCAL_BYTES / 4))).cast("int")
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "x long, y long")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = rows.select("region", "key", "block", F.explode(other).alias("o"))
    met = met.select("region", "key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.when(F.col("block") == F.col("o"), 0).otherwise(F.when(F.col("block") < F.col("o"), 1).otherwise(2)).alias("side"))
    return through_table(_join_small(met.join(sets, "key").select("region", "i", "j", "key", "set", "side"), percent, ["region", "i", "j"]), "blocks")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node in links x, y: large and small stars in turn (Kiveris and others, "Connected components in MapReduce and beyond", 2014). A round's tables go when the next one is written."""
    spark = links.sparkSession
    root = shared_folder(spark, "components")

    def written(df: DataFrame, turn: int, name: str) -> DataFrame:
        return through_table(df, name, inner_folder(spark, f"{root}/{turn}"))

    edges = written(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), 0, "edges")
    mark, turn = None, 0
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), turn, "least")
        large = written(both.join(least, "x").where("y > x and y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), turn, "large")
        small_least = written(large.groupBy("x").agg(F.min("y").alias("m")), turn, "small")
        small = large.join(small_least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(small_least.select("x", F.col("m").alias("y")))
        edges = written(small.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), turn, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        drop_folder(spark, f"{root}/{turn - 1}")
        if now == mark:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("component"))
        mark = now


INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def group_documents(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, class_id (the least key with an equal set), component_id for each row."""
    kind = docs.schema[key].dataType.simpleString()
    if kind in INTEGRAL:
        named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
        found = _group(named, size, percent)
        return found.select(F.col("key").cast(kind).alias(key), "n_shingles", *(F.col(c).cast(kind).alias(c) for c in ("class_id", "component_id")))
    # keys of other types are numbered in their order, so that the least number is the least key's
    numbers = through_table(docs.select(F.col(key).alias("_of")).where("_of is not null").distinct().orderBy("_of").select("_of", F.monotonically_increasing_id().alias("key")), "keys")
    named = docs.select(F.col(key).alias("_of"), F.col(text).cast("string").alias("text")).join(numbers, "_of", "left").select("key", "text")
    found = _group(named, size, percent)
    for c in ("key", "class_id", "component_id"):
        found = found.join(numbers.select(F.col("key").alias("_n"), F.col("_of").alias(f"_{c}")), F.col(c) == F.col("_n"), "left").drop("_n", c)
    return found.select(F.col("_key").alias(key), "n_shingles", F.col("_class_id").alias("class_id"), F.col("_component_id").alias("component_id"))


def _group(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """group_documents of rows key (long), text."""
    spark = docs.sparkSession
    weight = text_bytes(docs)
    root, shards = shared_folder(spark, "jaccard"), shards_for(spark, weight)
    table = through_table(document_table(docs, size), "documents", root)
    copies = _store_copies(table, f"{root}/copies", shards)
    keyed = docs.where("key is not null")
    sizes = _count_shingles(keyed, size, copies, f"{root}/shingles", shards)
    release_shuffles(spark, weight)  # the arrays hold what the shuffle carried
    candidates = through_table(_candidates(keyed, size, percent, copies, f"{root}/shingles", sizes), "candidates", root)
    for done in ("copies", "shingles"):
        drop_folder(spark, f"{root}/{done}")
    links = region_links(candidates, percent)
    classes = through_table(table.where("key is not null and n_shingles > 0").groupBy("a", "b").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "classes", root)
    classed = table.join(classes, ["a", "b"], "left").select("key", "n_shingles", F.when(F.col("key").isNotNull(), F.coalesce("class_id", "key")).alias("class_id"))
    # rows with one key are one document, whatever their sets
    twice = classed.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("class_id").alias("of"), F.max("class_id").alias("to")).where("c > 1")
    several = classed.join(twice.where("of <> to or key <> of").select("key"), "key", "left_semi").select(F.col("key").alias("x"), F.col("class_id").alias("y")).where("x <> y")
    found = components(links.unionByName(several))
    return classed.join(found, F.col("class_id") == F.col("node"), "left").select("key", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return group_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
classes AS (SELECT doc_id, s, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS class_id FROM sets),
one AS (SELECT class_id, any_value(s) AS s FROM classes WHERE len(s) > 0 GROUP BY class_id),
shingles AS (SELECT class_id, len(s) AS n, hash(unnest(s)) AS g FROM one),
pairs AS (SELECT a.class_id AS x, b.class_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS both_ FROM shingles a JOIN shingles b ON a.g = b.g AND a.class_id < b.class_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * both_ >= 85 * (n + m - both_)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, near) AS (SELECT class_id, class_id FROM one UNION SELECT r.node, e.y FROM reach r JOIN edges e ON e.x = r.near),
components AS (SELECT node, min(near) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s) AS n_shingles, class_id, coalesce(component_id, class_id) AS component_id FROM classes LEFT JOIN components ON node = class_id
"""
