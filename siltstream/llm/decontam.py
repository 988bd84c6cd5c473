"""Benchmark decontamination: which texts hold a test item, whole, but for a tenth of its characters.

An item of m characters may differ by k = m // 10 edits. Cut into k + 1 pieces, at least one
piece stands in the text unchanged (pigeonhole); one Aho-Corasick pass finds all pieces of all
items. A piece that is hit is verified upwards in a balanced tree over the item's pieces: a node
of s pieces must match nearby with at most s - 1 edits, or this hit leads nowhere (were both
halves of a node over their budgets, so would be the node). Distances are Myers' bit-parallel
ones; the root's is the item's.

Texts and items are compared in lower case with every run of white space as one space. An item of
under ten characters may not differ at all, and must stand between characters that are neither letters
nor digits (or at an end): "a" isn't held by every word with an a.

The items are cut into blocks of about BLOCK bytes, by a hash of item and text, which tasks write to the shared
folder; the driver sees none of them. The texts are read once: a task holds HELD bytes of them at a time
and matches them by each block in turn, so memory depends on neither table's size, and a benchmark
of one block has its matcher built once for each worker.

Defined results: null, empty or blank texts and items match nothing. A text of any length is searched whole, in
memory that grows with its own length. A text gives one row for each item it holds, with the least number of edits and,
of equal ones, the first place where such a match ends. Repeated rows of texts give repeated
matches; repeated rows of items count once, items with one id by their best. A null item id is an id of its own.
Empty tables give an empty one. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._bytes import small_batches
from ._shared import begin_stage, cache, read_file, shared_folder, write_file

RATE = 10
#: Bytes of items in one matcher, and of texts that a task holds while it goes through the blocks.
BLOCK, HELD = 4 << 20, 8 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, most: int) -> list[tuple[int, int]]:
    """(distance, end) for each place of text where a part within `most` edits of the pattern ends. (Myers, "A fast bit-vector algorithm for approximate string matching", 1999.)"""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = full, 0, m
    out = []
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
        if score <= most:
            out.append((score, j))
    return out


class Item:
    """An item's pieces, and the tree above them: nodes (start, end, budget, parent, masks), the root last."""

    def __init__(self, item_id, text: str):
        self.id, self.text = item_id, text
        n = len(text) // RATE + 1
        cuts = [i * len(text) // n for i in range(n + 1)]
        self.pieces = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.starts, self.above = cuts[:-1], [0] * n
        self.nodes: list[list] = []

        def grow(lo: int, hi: int) -> int:
            """The node's number; a child's is less than its parent's."""
            children = []
            if hi - lo > 1:
                middle = (lo + hi) // 2
                children = [grow(a, b) if b - a > 1 else None for a, b in ((lo, middle), (middle, hi))]
            number = len(self.nodes)
            self.nodes.append([cuts[lo], cuts[hi], hi - lo - 1, None, masks(text[cuts[lo] : cuts[hi]])])
            for part, child in zip(((lo, (lo + hi) // 2), ((lo + hi) // 2, hi)), children, strict=False):
                if child is None:
                    self.above[part[0]] = number
                else:
                    self.nodes[child][3] = number
            if hi - lo == 1:
                self.above[lo] = number
            return number

        grow(0, n)

    def verify(self, hits: list[tuple[int, int]], text: str) -> tuple[int, int] | None:
        """The least edits and the first such end, from (piece, place) hits. Windows of a node that overlap are read as one, so a text that repeats itself costs no more than its length for each level."""
        windows: list[list[tuple[int, int]]] = [[] for _ in self.nodes]
        for j, begin in hits:
            s, e, budget, _, _ = self.nodes[self.above[j]]
            offset = self.starts[j]
            windows[self.above[j]].append((begin - (offset - s) - budget, begin + (e - offset) + budget))
        if len(self.pieces) == 1:
            n = len(self.text)
            ends = [a + n for _, a in hits if not (a and text[a - 1].isalnum() or text[a + n : a + n + 1].isalnum())]
            return (0, min(ends)) if ends else None
        best = None
        for number, (s, e, budget, parent, peq) in enumerate(self.nodes):
            right = 0
            spans: list[list[int]] = []
            for a, b in sorted(windows[number]):
                if spans and a <= right:
                    spans[-1][1] = right = max(right, b)
                else:
                    spans.append([a, b])
                    right = b
            for a, b in spans:
                a = max(a, 0)
                for edits, end in myers(peq, e - s, text[a:b], budget):
                    if parent is None:
                        best = min(best, (edits, a + end)) if best else (edits, a + end)
                    else:
                        above, below, room, _, _ = self.nodes[parent]
                        windows[parent].append((a + end - (e - above) - room, a + end + (below - e) + room))
        return best


class Matcher:
    def __init__(self, items: list[tuple[object, str]]):
        import ahocorasick

        self.items = [Item(i, t) for i, t in items]
        hits: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for j, piece in enumerate(item.pieces):
                hits.setdefault(piece, []).append((n, j))
        self.machine = ahocorasick.Automaton()
        for piece, at in hits.items():
            self.machine.add_word(piece, (len(piece), at))
        if hits:
            self.machine.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """By item number: its least edits in a normalised text, and where the first such match ends."""
        hits: dict[int, list[tuple[int, int]]] = {}
        if len(self.machine):
            for last, (size, at) in self.machine.iter(text):
                for n, j in at:
                    hits.setdefault(n, []).append((j, last + 1 - size))
        found = {n: self.items[n].verify(at, text) for n, at in hits.items()}
        return {n: m for n, m in found.items() if m is not None}


_made: dict[str, Matcher] = cache()


def _matcher(uri: str, block: int) -> Matcher:
    name = f"{uri}/{block}"
    if name not in _made:
        _made.clear()
        _made[name] = Matcher(pickle.loads(read_file(name)))
    return _made[name]


def write_blocks(items: DataFrame, item: str, text: str, most: int = BLOCK) -> tuple[str, list[int]]:
    """The normalised items, in files of about `most` bytes in the shared folder: the folder, and the numbers of the files."""
    spark = items.sparkSession
    kind = items.schema[item].dataType.simpleString()

    def normalised(batches):
        for batch in small_batches(batches, column=1):
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["item", "text"]).filter(pa.array([t != "" for t in texts], pa.bool_()))

    rows = items.select(F.col(item), F.col(text).cast("string")).mapInArrow(normalised, f"item {kind}, text string").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    uri, n = shared_folder(spark, "benchmark"), -(-size // most)
    if not n:
        return uri, []

    def store(key, table):
        held = sorted(zip(table["item"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[1], str(r[0])))
        write_file(f"{uri}/{key[0].as_py()}", pickle.dumps(held))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64())})

    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return uri, sorted(r.block for r in rows.withColumn("block", block).groupBy("block").applyInArrow(store, "block long").collect())  # a number for each file


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about HELD bytes of text."""
    out, size = [], 0
    for batch in small_batches(batches, HELD, column=1):
        out.append(batch)
        size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
        if size >= HELD:
            yield out
            out, size = [], 0
    if out:
        yield out


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most: int = BLOCK) -> DataFrame:
    """key, item, edits, at_end for each text and each item that it holds."""
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, key), (items, item)))
    schema = f"`{key}` {kind}, `{item}` {item_kind}, edits int, at_end long"
    item_type = to_arrow_type(items.schema[item].dataType)
    uri, blocks = write_blocks(items, item, item_text, most)
    names = [key, item, "edits", "at_end"]

    def match(batches):
        begin_stage(uri)
        for held in _held(batches):
            best: dict[tuple[int, int], dict] = {}  # by batch and row: the best match of each item
            texts = [[normal(t.as_py()) for t in b.column(1)] for b in held]
            for block in blocks:
                matcher = _matcher(uri, block)
                for k, of in enumerate(texts):
                    for i, t in enumerate(of):
                        for n, m in matcher.find(t).items():
                            mine, name = best.setdefault((k, i), {}), matcher.items[n].id
                            mine[name] = min(mine.get(name, m), m)
            for k, batch in enumerate(held):
                found = [(i, name, *m) for i in range(batch.num_rows) for name, m in best.get((k, i), {}).items()]
                rows, what, edits, ends = zip(*found, strict=True) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(rows, np.int64))), pa.array(what, item_type), pa.array(edits, pa.int32()), pa.array(ends, pa.int64())], names)

    return docs.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(match, schema)


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_items(docs, items)
