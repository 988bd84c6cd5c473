"""Encoding by sampled segmentations: Gumbel top-k without replacement over the unigram lattice, and decoding.

A text's lattice falls into units where no piece can reach across (see _pieces), so a
segmentation's probability is a product over units. Each distinct unit's lattice gets its
forward sums once; a segmentation is then drawn backwards from them.

The search is A-star over sets of segmentations, best perturbed bound first (Kool, van Hoof,
Welling, "Stochastic beams and where to find them", 2019; Maddison, Tarlow, Minka, "A* sampling",
2014). The root holds all segmentations and has a Gumbel value G. A set taken from the agenda
yields one segmentation s, drawn in proportion within the set, which has the set's value; the rest
of the set splits into two sets by where a segmentation leaves the one that the set was made around,
and their values are Gumbel(log mass) cut off at the parent's. The bounds are exact, so the first k
sets taken give the k largest perturbed log probabilities of all segmentations: k distinct ones,
drawn without replacement. The value k + 1 is the threshold t by which each has its inclusion score
1 - exp(-exp(log_prob - t)).

Masses of what remains are added up from the other arcs, in logarithms where need be, never taken as one
less what is gone: so no set is lost because it is small, and a text gives all it has.

Every uniform number is a function of (seed, row key, sample, unit, step): a row's samples are
the same on any partitioning and after any lost task.

Defined results: a text with fewer than k segmentations gives those it has, with inclusion 1; a
null or empty text has one, without pieces. A null key is a key of its own; rows that repeat a key
and text repeat its samples. Equal scores are no ties: values differ with probability 1, and equal values go by the
order in which the sets were made. A text of any length is done whole, in memory that grows with its own length. An empty
table gives an empty one. Further columns are not read, whatever their names. A space and the vocabulary's mark are one,
as in the public encoder, so decoding gives the text with its marks as spaces; all else round-trips.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U64, chunks, mix64, small_batches, span_hashes
from ._pieces import Automaton, Vocabulary, automaton, marked, shared_automaton
from ._shared import begin_stage
from .tokencount import PIECES

SAMPLES, SEED, CHUNK = 2, 7, 5 << 17


def scatter(*parts) -> np.ndarray:
    """A 64-bit number, a function of the 64-bit parts."""
    x = U64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            x = mix64(np.asarray(p).astype(U64) + x * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))
    return x


def uniform(*parts) -> np.ndarray:
    """Numbers in (0, 1), a function of the 64-bit parts."""
    return ((scatter(*parts) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def scatter1(*parts: int) -> int:
    """scatter() of whole numbers, without arrays."""
    x, mask = 0, (1 << 64) - 1
    for p in parts:
        x = p + x * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        x ^= x >> 31
    return x


def uniform1(*parts: int) -> float:
    return ((scatter1(*parts) >> 11) + 0.5) * 2.0**-53


class Lattice:
    """The lattices of some distinct units: for each end cell the pieces that end there, with their shares of the forward sum."""

    def __init__(self, machine: Automaton, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        order = np.argsort(start - end, kind="stable")
        start, end = start[order], end[order]
        base = np.concatenate([[0], np.cumsum(end - start + 1)])
        total = np.full(base[-1], -np.inf)
        total[base[:-1]] = 0
        cells, came, piece, logs = [], [], [], []
        for t, rounds in machine.matches(data, start, end):
            for idx, p, size in rounds:
                to, source = base[idx] + t + 1, base[idx] + t + 1 - size
                made = total[source] + (machine.unknown if p[0] < 0 else machine.scores[p])
                total[to] = np.logaddexp(total[to], made)
                cells.append(to)
                came.append(source)
                piece.append(p)
                logs.append(made)
        if cells:
            cells, self.came, self.piece, logs = (np.concatenate(x) for x in (cells, came, piece, logs))
        else:
            cells, self.came, self.piece, logs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        by = np.argsort(cells << 7 | cells - self.came)  # the pieces of a cell differ in length: one order, whatever else is in the chunk
        place = np.int32 if base[-1] < 1 << 31 else np.int64
        cells, self.came, self.piece = cells[by].astype(place), self.came[by].astype(place), self.piece[by].astype(np.int32)
        self.size = cells - self.came  # bytes of each arc's piece
        self.log_share = np.minimum(logs[by] - total[cells], 0.0)
        del by, logs, total
        self.share = share = np.exp(self.log_share)
        self.edges = np.searchsorted(cells, np.arange(base[-1] + 1))
        self.log_other = self._others(cells)
        self.other = np.exp(self.log_other)
        #: Whether an arc's others are too small for a plain number.
        self.faint = (self.log_other < -600) & (self.log_other > -np.inf)
        sums = np.concatenate([[0.0], np.cumsum(share)])
        within = sums[1:] - sums[self.edges[cells]]
        within[self.edges[cells + 1] - 1 == np.arange(len(cells))] = np.inf  # the last of a cell takes what rounding leaves
        self.up_to = within
        self.first, self.last = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        self.first[order], self.last[order] = base[:-1], base[1:] - 1

    def _others(self, cells: np.ndarray) -> np.ndarray:
        """For each arc, the logarithm of the shares of the cell's other arcs, added up from both sides."""
        n = len(cells)
        out = np.full(n, -np.inf)
        place = np.arange(n) - self.edges[cells]
        size = np.diff(self.edges)[cells]
        for side in (1, -1):
            so_far = np.full(n, -np.inf)
            for k in range(1, int(size.max()) if n else 0):
                at = np.flatnonzero(place == k if side > 0 else place == size - 1 - k)
                so_far[at] = np.logaddexp(so_far[at - side], self.log_share[at - side])
            out = np.logaddexp(out, so_far)
        return out

    def draw(self, unit: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation for each of the units: the arcs of all in order, their bounds, each one's log probability, and the log probability of all others of the unit."""
        n = len(unit)
        at, count, log = self.last[unit].copy(), np.zeros(n, np.int64), np.zeros(n)
        p, rest, faint = np.ones(n), np.zeros(n), np.zeros(n, bool)
        live, steps = np.arange(n), []
        first = self.first[unit]
        any_faint = self.faint.any()
        live = live[at > first]
        while len(live):
            u = ((mix64(seeds[live] + U64(len(steps))) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
            arc = self.edges[at[live]]
            on = np.flatnonzero(self.up_to[arc] < u)
            while len(on):
                arc[on] += 1
                on = on[self.up_to[arc[on]] < u[on]]
            steps.append((live, arc))
            log[live] += self.log_share[arc]
            rest[live] += p[live] * self.other[arc]
            p[live] *= self.share[arc]
            if any_faint:
                faint[live] |= self.faint[arc]
            count[live] += 1
            at[live] = self.came[arc]
            live = live[at[live] > first[live]]
        bounds = np.concatenate([[0], np.cumsum(count)])
        arcs = np.empty(bounds[-1], np.int64)
        for k, (who, arc) in enumerate(steps):
            arcs[bounds[who + 1] - 1 - k] = arc
        near = rest < 0.5
        log[near] = np.log1p(-rest[near])
        with np.errstate(divide="ignore"):
            log_rest = np.log(np.minimum(rest, 1.0))
        for i in np.flatnonzero(faint & (rest < 1e-250)):
            log_rest[i] = self.log_rest(arcs[bounds[i] : bounds[i + 1]])
        return arcs, bounds, log, log_rest

    def log_rest(self, arcs) -> float:
        """The log probability of all segmentations of a unit but one (its arcs from the first to the last)."""
        out, log = -math.inf, 0.0
        for arc in reversed(arcs):
            out = float(np.logaddexp(out, log + self.log_other[arc]))
            log += float(self.log_share[arc])
        return out

    def without(self, unit: int, taken: list[list[int]]) -> "Without":
        return Without(self, int(self.last[unit]), int(self.first[unit]), taken)


class Without:
    """The segmentations of one unit but those `taken` (each a list of arcs from the first to the last): a tree of the taken ones from the end, with the log mass of what else there is below each node."""

    def __init__(self, lattice: Lattice, last: int, first: int, taken: list[list[int]]):
        self.lattice, self.first, self.last = lattice, first, last
        self.cells, self.below = [last], [{}]  # below: arc -> node, or -1 where a taken segmentation is complete
        for arcs in taken:
            node = 0
            for arc in reversed(arcs):
                came = int(lattice.came[arc])
                if came == first:
                    self.below[node][arc] = -1
                    break
                if arc not in self.below[node]:
                    self.below[node][arc] = len(self.cells)
                    self.cells.append(came)
                    self.below.append({})
                node = self.below[node][arc]
        self.mass = [0.0] * len(self.cells)
        for node in range(len(self.cells) - 1, -1, -1):  # a node comes after the one above it
            w = self._weights(node)[1]
            top = max(w)
            self.mass[node] = top + math.log(sum(math.exp(x - top) for x in w)) if top > -math.inf else -math.inf

    def _weights(self, node: int) -> tuple[range, list[float]]:
        below, cell = self.below[node], self.cells[node]
        arcs = range(int(self.lattice.edges[cell]), int(self.lattice.edges[cell + 1]))
        return arcs, [float(self.lattice.log_share[a]) + ((self.mass[below[a]] if below[a] >= 0 else -math.inf) if a in below else 0.0) for a in arcs]

    def draw(self, numbers) -> tuple[list[int], float]:
        """One of them in proportion, and its log probability among all of the unit."""
        lattice, node, cell, out, log = self.lattice, 0, self.last, [], 0.0
        while cell > self.first:
            if node >= 0:
                arcs, w = self._weights(node)
            else:
                arcs = range(int(lattice.edges[cell]), int(lattice.edges[cell + 1]))
                w = [float(lattice.log_share[a]) for a in arcs]
            top = max(w)
            w = [math.exp(x - top) for x in w]
            x, k = next(numbers) * sum(w), w.index(1.0)
            for i, m in enumerate(w):
                if m > 0 and x <= m:
                    k = i
                    break
                x -= m
            arc = arcs[k]
            node = self.below[node].get(arc, -1) if node >= 0 else -1
            out.append(arc)
            log += float(lattice.log_share[arc])
            cell = int(lattice.came[arc])
        return out[::-1], log


def _log_sum(x: np.ndarray) -> float:
    top = float(x.max()) if len(x) else -math.inf
    return top + math.log(float(np.exp(x - top).sum())) if top > -math.inf else -math.inf


class Sample:
    """A segmentation that was drawn: its arcs, their bounds by unit, and by unit its log probability and that of all others."""

    def __init__(self, arcs: np.ndarray, cuts: np.ndarray, logs: np.ndarray, rest: np.ndarray, value: float):
        self.arcs, self.cuts, self.logs, self.rest, self.value = arcs, cuts, logs, rest, value

    def at(self, unit: int) -> list[int]:
        return self.arcs[self.cuts[unit] : self.cuts[unit + 1]].tolist()

    def later(self, unit: int) -> float:
        """The log probability that one leaves this at `unit` or after, given that it agrees before."""
        if unit >= len(self.logs):
            return -math.inf
        gone = float(self.logs[unit:].sum())
        if gone < -1e-250:
            return math.log(-math.expm1(gone))
        return _log_sum(np.cumsum(self.logs[unit:]) - self.logs[unit:] + self.rest[unit:])


class Around:
    """The set of segmentations that agree with a sample before unit `at` and leave it there or later, but at none of the units `skip`; at `at` itself they aren't one of `taken` either."""

    def __init__(self, sample: Sample, at: int, taken: list[list[int]], others: "Without | None", skip: tuple[int, ...] = ()):
        self.sample, self.at, self.taken, self.others, self.skip = sample, at, taken, others, skip

    def masses(self) -> np.ndarray:
        """The log mass of those that leave the sample at each unit from `at`, as part of all segmentations."""
        s, at = self.sample, self.at
        out = s.rest[at:].copy()
        if self.others is not None:
            out[0] = self.others.mass[0]
        out[1:] += np.cumsum(s.logs[at:-1])
        for j in self.skip:
            out[j - at] = -np.inf
        return out + float(s.logs[:at].sum())

    def mass(self) -> float:
        """Of a set without skipped units."""
        s, at = self.sample, self.at
        here = self.others.mass[0] if self.others is not None else float(s.rest[at])
        return float(s.logs[:at].sum()) + float(np.logaddexp(here, float(s.logs[at]) + s.later(at + 1)))


class Row:
    """The search in one text."""

    def __init__(self, key: int, unit: np.ndarray):
        self.key, self.unit, self.done = key, unit, []
        self.made = 0
        self.agenda: list[tuple[float, int, Around | None]] = [(math.log(-math.log(uniform1(key, 0, 0, 1 << 40))), 0, None)]

    def push(self, around: Around, mass: float, value: float) -> None:
        """A set of this log mass, with a Gumbel value cut off at `value`."""
        if mass == -math.inf:
            return
        self.made += 1
        draw = -math.log(uniform1(self.key, self.made, 0, (1 << 40) + 1))
        heapq.heappush(self.agenda, (float(np.logaddexp(-value, math.log(draw) - mass)), self.made, around))


SAMPLES_MAX = 64


def _search(machine: Automaton, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int):
    """For each text of a chunk: its samples as (lattice, arcs, log probability, perturbed, threshold)."""
    start, end, bounds = machine.units(data, offsets)
    _, first, unit = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    lattice = Lattice(machine, data, start[first], end[first])
    rows = [Row(int(keys[i]), unit[bounds[i] : bounds[i + 1]]) for i in range(len(offsets) - 1)]
    for number in range(k):
        todo = []  # (row, value, the set, the unit at which the sample leaves the set's, what it is there and its log probability)
        for i, r in enumerate(rows):
            if not r.agenda:
                continue
            value, _, around = heapq.heappop(r.agenda)
            if around is None:
                todo.append((i, -value, None, -1, None, 0.0))
                continue
            masses = around.masses()
            sums = np.cumsum(np.exp(masses - masses.max()))
            j = int(np.searchsorted(sums, uniform1(r.key, number, 0, 3 << 40) * sums[-1]))
            at = around.at + j
            taken = [*(around.taken if j == 0 else ()), around.sample.at(at)]
            others = around.others if j == 0 and around.others is not None else lattice.without(int(r.unit[at]), taken)
            numbers = (uniform1(r.key, number, at, (2 << 40) + n) for n in itertools.count())
            todo.append((i, -value, around, at, taken, others.draw(numbers)))
            masses[j] = -np.inf
            r.push(Around(around.sample, around.at, around.taken, around.others, (*around.skip, at)), _log_sum(masses), -value)
        if not todo:
            break
        # the units after the one at which each sample leaves its set's are drawn freely, all rows at once
        free = [rows[i].unit[at + 1 :] for i, _, _, at, _, _ in todo]
        sizes = np.array([len(f) for f in free])
        place = np.concatenate([np.arange(at + 1, at + 1 + n) for (_, _, _, at, _, _), n in zip(todo, sizes, strict=True)])
        arcs, cuts, logs, rest = lattice.draw(np.concatenate(free), scatter(np.repeat(scatter(keys[[i for i, *_ in todo]], number), sizes), place))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for (i, value, around, at, taken, other), a, b in zip(todo, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            r = rows[i]
            mine, steps, log, others = arcs[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a], logs[a:b], rest[a:b]
            if around is not None:
                old, here = around.sample, other[0]
                mine = np.concatenate([old.arcs[: old.cuts[at]], np.array(here, np.int64), mine])
                steps = np.concatenate([old.cuts[: at + 1], steps + old.cuts[at] + len(here)])
                left = lattice.log_rest(here)
                log = np.concatenate([old.logs[:at], [math.log1p(-math.exp(left)) if left < -1.0 else other[1]], log])
                others = np.concatenate([old.rest[:at], [left], others])
            sample = Sample(mine, steps, log, others, value)
            r.done.append(sample)
            if len(r.unit):
                taken = taken or []
                made = Around(sample, max(at, 0), taken, lattice.without(int(r.unit[at]), [*taken, sample.at(at)]) if taken else None)
                r.push(made, made.mass(), value)
    for r in rows:
        limit = -r.agenda[0][0] if r.agenda and len(r.done) == k else -np.inf
        yield [(lattice, x.arcs, float(x.logs.sum()), x.value, limit) for x in r.done]


class Decoder:
    """From ids to text: pieces' bytes end to end, the first mark dropped."""

    def __init__(self, machine: Automaton, vocabulary: Vocabulary):
        self.of = dict(vocabulary.pieces) | {i: bytes([b]) for b, i in vocabulary.byte_ids.items()}

    def bytes(self, ids) -> bytes:
        return b"".join(map(self.of.__getitem__, ids))[1:]

    def text(self, ids) -> str:
        return self.bytes(ids).decode()


def sample_segmentations(docs: DataFrame, vocabulary: Vocabulary, samples: int = SAMPLES, seed: int = SEED, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """`samples` distinct segmentations of each row's text, a row for each: `key`, sample (from 0, by falling perturbed value), n_pieces, log_prob, perturbed, inclusion, ids_md5 (of the ids as 32-bit numbers), round_trip (decoding the ids gives the text), and the ids."""
    if not 1 <= samples <= SAMPLES_MAX:
        raise ValueError(f"samples must be 1 to {SAMPLES_MAX}")
    kind = docs.schema[key].dataType.simpleString()
    uri = shared_automaton(docs.sparkSession, vocabulary)
    fields = f"`{key}` {kind}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_md5 string, round_trip boolean" + ", ids array<int>" * with_ids

    def sampled(batches):
        begin_stage(uri)
        machine = automaton(uri)
        speller = Speller(machine, vocabulary)
        for batch in small_batches(batches, CHUNK):
            seeds = np.asarray(batch.column(2)).astype(U64)
            for first, data, offsets in chunks(marked(batch.column(0)), CHUNK):
                out = {n: [] for n in ("row", "sample", "log", "value", "inclusion")}
                chosen, lattice = [], None
                for i, found in enumerate(_search(machine, data, offsets, seeds[first : first + len(offsets) - 1], samples)):
                    for k, (lattice, arcs, log, value, limit) in enumerate(found):
                        chosen.append(arcs)
                        out["row"].append(i)
                        out["sample"].append(k)
                        out["log"].append(log)
                        out["value"].append(value)
                        out["inclusion"].append(-math.expm1(-math.exp(min(log - limit, 700.0))))
                if lattice is None:
                    continue
                ids, bounds, out["ok"] = speller.spell(lattice, chosen, data, offsets, np.array(out["row"]))
                out["n"] = np.diff(bounds)
                out["md5"] = [hashlib.md5(ids[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                out["row"] = first + np.array(out["row"])
                row = pa.array(out.pop("row"), pa.int64())
                columns = [batch.column(1).take(row), pa.array(out["sample"], pa.int32()), pa.array(out["n"], pa.int64()), *(pa.array(out[n], pa.float64()) for n in ("log", "value", "inclusion")), pa.array(out["md5"], pa.string()), pa.array(out["ok"], pa.bool_())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_md5", "round_trip", *["ids"] * with_ids]
    row_seed = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    return docs.select(F.col(text).cast("string").alias("_text"), F.col(key), row_seed.alias("_seed")).mapInArrow(sampled, fields)


class Speller:
    """Ids of segmentations, and the check that they decode to their texts, for many at once."""

    def __init__(self, machine: Automaton, vocabulary: Vocabulary):
        self.machine = machine
        self.at = np.concatenate([[0], np.cumsum(machine.lengths)])
        self.pool = np.frombuffer(b"".join(vocabulary.pieces.values()), np.uint8)
        self.byte_of = np.zeros(int(machine.byte_ids.max()) + 1, np.uint8)
        known = np.flatnonzero(machine.byte_ids >= 0)
        self.byte_of[machine.byte_ids[known]] = known

    def spell(self, lattice: Lattice, chosen: list[np.ndarray], data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids end to end, their bounds, and whether each segmentation's ids decode to its row's text (the first mark still before it)."""
        arcs = np.concatenate(chosen)
        piece, size = lattice.piece[arcs], lattice.size[arcs]
        n_arcs = np.array([len(c) for c in chosen])
        arc_bounds = np.concatenate([[0], np.cumsum(n_arcs)])
        total = np.concatenate([[0], np.cumsum(size)])
        # positions in the texts end to end need 32 bits, but for a text of a gigabyte
        place = np.int32 if total[-1] < 1 << 31 and len(data) < 1 << 31 else np.int64
        size = size.astype(place)
        at = total[:-1].astype(place)
        begin, length = total[arc_bounds[:-1]], np.diff(total[arc_bounds])
        whole = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in rows.tolist()])
        unknown = piece < 0
        copies = np.where(unknown, size, place(1))  # an unknown character is as many ids as bytes
        ids = np.repeat(self.machine.ids[np.maximum(piece, 0)].astype(np.int32), copies)
        strange = np.flatnonzero(unknown)
        n = size[strange]
        inner = np.arange(int(n.sum()), dtype=place) - np.repeat((np.cumsum(n) - n).astype(place), n)
        ends = np.cumsum(copies)
        raw = np.repeat((ends - copies)[strange], n) + inner
        places = np.repeat(at[strange], n) + inner
        bounds = np.concatenate([[0], ends])[arc_bounds]
        if len(whole) != total[-1]:
            raise AssertionError("a segmentation doesn't cover its text")
        ids[raw] = self.machine.byte_ids[whole[places]]
        # decode: the bytes of each id, one after another
        decoded = np.empty(int(total[-1]), np.uint8)
        known = np.flatnonzero(~unknown)
        n = size[known]
        source = np.arange(int(n.sum()), dtype=place)
        source += np.repeat(self.at[piece[known]].astype(place) - (np.cumsum(n) - n).astype(place), n)
        to = np.ones(int(total[-1]), bool)
        to[places] = False
        decoded[to] = self.pool[source]  # known pieces fill what unknown characters leave, in order
        decoded[places] = self.byte_of[ids[raw]]
        wrong = np.concatenate([[0], np.cumsum(decoded != whole)])
        same = (wrong[begin + length] == wrong[begin]) & (length == np.diff(offsets)[rows])
        return ids, bounds, same


def op9_segmentation_sampling(spark, sf_dir: str) -> DataFrame:
    return sample_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"), Vocabulary.read(PIECES).zipf())
