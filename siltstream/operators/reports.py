"""Whole-stream reports: totals, ledgers, tallies of metadata, filters by member, judgements at restarts.

All are DataFrame functions. Totals are partial aggregates, so a stream that makes up most of the records is
summed on the map side; what must be read in order is a window by stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .findings import SEVERITIES, severity_rank

CLOCK = 65_536


# -- totals


def stream_totals(units: DataFrame, stream: Sequence[str], unit: str, size: str, gap: Column, sync: Column, per_unit: int, rate: int) -> DataFrame:
    """One row a stream: units, bytes, largest unit and where (the first of equals), syncs, gaps and the bytes in them, first and last unit, seconds (units times samples over the rate), and bits a second (null without units)."""
    lost = F.coalesce(gap, F.lit(0))
    out = units.groupBy(*stream).agg(
        F.count(F.lit(1)).alias("units"), F.sum(size).alias("bytes"), F.max(F.struct(F.col(size).alias("s"), (-F.col(unit)).alias("u"))).alias("_m"),
        F.count_if(sync).alias("syncs"), F.count_if(lost > 0).alias("gaps"), F.sum(lost).alias("gap_bytes"), F.min(unit).alias("first_unit"), F.max(unit).alias("last_unit"),
    )
    return out.select(*stream, "units", "bytes", F.col("_m.s").alias("max_bytes"), (-F.col("_m.u")).alias("max_at"), "syncs", "gaps", "gap_bytes", "first_unit", "last_unit", (F.col("units") * per_unit / F.lit(float(rate))).alias("seconds")).withColumn(
        "bits_per_second", F.try_divide(F.col("bytes") * 8.0, F.col("seconds"))
    )


def part_totals(units: DataFrame, stream: Sequence[str], part: str, size: str, faulty: Column) -> DataFrame:
    """By stream and part: segments, bytes, smallest and largest segment, faulty segments."""
    return units.groupBy(*stream, part).agg(F.count(F.lit(1)).alias("segments"), F.sum(size).alias("bytes"), F.min(size).alias("least"), F.max(size).alias("most"), F.count_if(faulty).alias("faulty"))


def findings_of(sources: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """The findings of several passes as one table, with `source`: which pass made each."""
    out = None
    for name, df in sources.items():
        part = df.select(*columns, F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def stream_report(totals: DataFrame, findings: DataFrame, stream: Sequence[str], severity: str = "severity", lossy: Column | None = None) -> DataFrame:
    """totals with each stream's findings by severity, its worst severity, and its exit code: 7 with an error or worse, else 4 if lossy, else 0. A stream without findings is clean."""
    counted = findings.groupBy(*stream).agg(*(F.count_if(F.col(severity) == s).alias(s) for s in SEVERITIES), F.max(severity_rank(F.col(severity))).alias("_w"))
    out = totals.join(counted, list(stream), "left").na.fill(0, list(SEVERITIES))
    names = F.array(*(F.lit(s) for s in SEVERITIES))
    code = F.when(F.col("_w") >= SEVERITIES.index("error"), 7).when(F.lit(False) if lossy is None else lossy, 4).otherwise(0)
    return out.withColumn("worst", F.get(names, F.col("_w"))).withColumn("exit_code", code).drop("_w")


def by_presentation(df: DataFrame, presentation: str, counters: Sequence[str]) -> DataFrame:
    """The counters summed by presentation, and once over all (presentation null, `whole` true)."""
    return df.rollup(presentation).agg(*(F.sum(c).alias(c) for c in counters), (F.grouping(presentation) == 1).alias("whole"))


def pass_totals(frames: DataFrame, programme: str, size: str, rate: str, blocks: str) -> DataFrame:
    """One row a programme: frames, bytes, samples (256 for each block), seconds at each frame's own rate, and how many rates it used."""
    seconds = F.sum(F.col(blocks) * 256.0 / F.col(rate))
    return frames.groupBy(programme).agg(F.count(F.lit(1)).alias("frames"), F.sum(size).alias("bytes"), F.sum(F.col(blocks) * 256).alias("samples"), seconds.alias("seconds"), F.count_distinct(rate).alias("rates"))


def sweep_summary(results: DataFrame, clean: Column, group: str) -> DataFrame:
    """By group and over all (group null): results, those that are clean, those that failed."""
    return results.rollup(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(clean).alias("clean"), F.count_if(~clean).alias("failed"))


def exit_distribution(results: DataFrame, code: str) -> DataFrame:
    """How many results ended with each exit code, in the codes' order."""
    return results.groupBy(code).agg(F.count(F.lit(1)).alias("streams")).orderBy(code)


# -- ledgers


def note_losses(losses: DataFrame, kind: str, order: Sequence[str], by: Sequence[str] = (), examples: int = 3) -> DataFrame:
    """A ledger: count of each kind of loss, and the first `examples` places in order."""
    numbered = losses.withColumn("_k", F.row_number().over(Window.partitionBy(*by, kind).orderBy(*order)))
    kept = numbered.where(F.col("_k") <= examples).groupBy(*by, kind).agg(F.array_sort(F.collect_list(F.struct("_k", *order))).alias("_e"))
    counts = losses.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("count"))
    return counts.join(kept, [*by, kind]).select(*by, kind, "count", F.transform("_e", lambda e: F.struct(*(e[c].alias(c) for c in order))).alias("examples"))


def merge_ledgers(ledgers: DataFrame, kind: str, part: str, by: Sequence[str] = (), examples: int = 3) -> DataFrame:
    """Ledgers of parts as one: counts add up; of the examples the first, the parts in their order. A part holds at most `examples` of a kind, and only the first `examples` parts' can be kept."""
    first = F.row_number().over(Window.partitionBy(*by, kind).orderBy(part))
    kept = ledgers.withColumn("_k", first).where(F.col("_k") <= examples).groupBy(*by, kind).agg(F.array_sort(F.collect_list(F.struct("_k", "examples"))).alias("_e"))
    counts = ledgers.groupBy(*by, kind).agg(F.sum("count").alias("count"))
    return counts.join(kept, [*by, kind]).select(*by, kind, "count", F.slice(F.flatten(F.transform("_e", lambda e: e["examples"])), 1, examples).alias("examples"))


# -- metadata


def _named(grain: str, field: str):
    return lambda value: F.struct(F.lit(grain).alias("grain"), F.lit(field).alias("field"), value.alias("value"))


def payload_tally(payloads: DataFrame, grains: Mapping[str, Sequence[str]]) -> DataFrame:
    """(grain, field, value, n) for the fields of each grain (payload, element, block, update), each a column or an array column: arrays count by element, so no two grains mix."""
    items = []
    for grain, fields in grains.items():
        for f in fields:
            values = F.col(f) if payloads.schema[f].dataType.typeName() == "array" else F.array(F.col(f))
            items.append(F.transform(values.cast("array<string>"), _named(grain, f)))
    return payloads.select(F.explode(F.concat(*items)).alias("_i")).groupBy("_i.grain", "_i.field", "_i.value").agg(F.count(F.lit(1)).alias("n"))


def id_ranges(payloads: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """By payload id: how many, and the least and greatest of each value."""
    return payloads.groupBy(name).agg(F.count(F.lit(1)).alias("payloads"), *(f(c).alias(f"{w}_{c}") for c in values for w, f in (("min", F.min), ("max", F.max))))


def declaration_changes(containers: DataFrame, stream: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """By stream: declarations, distinct ones, and changes: how many differ from the one before. The first never counts."""
    w = Window.partitionBy(*stream).orderBy(*order)
    now = F.struct(*fields)
    marked = containers.withColumn("_now", now).withColumn("_c", F.row_number().over(w) > 1).withColumn("_d", ~now.eqNullSafe(F.lag(now).over(w)))
    return marked.groupBy(*stream).agg(F.count(F.lit(1)).alias("declarations"), F.count_distinct("_now").alias("kinds"), F.count_if(F.col("_c") & F.col("_d")).alias("changes"))


def first_records(df: DataFrame, order: Sequence[str], most: int, by: Sequence[str] = ()) -> DataFrame:
    """The first `most` records, of each stream if `by` says so: a dump of containers or payloads."""
    if not by:
        return df.orderBy(*order).limit(most)
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def payload_positions(payloads: DataFrame, units: DataFrame, key: Sequence[str], base: str, container: str, block_step: int) -> DataFrame:
    """payloads joined with their units: position = the unit's first sample + the container's offset + the payload's + block number times block_step."""
    joined = payloads.join(units.select(*key, base), list(key))
    return joined.withColumn("position", F.col(base) + F.coalesce(F.col(container), F.lit(0)) + F.coalesce(F.col("sample_offset"), F.lit(0)) + F.col("block") * block_step)


# -- members


def one_presentation(df: DataFrame, presentation: int, column: str = "presentation") -> DataFrame:
    return df.where(F.col(column) == presentation)


def one_programme(df: DataFrame, programme: int, column: str = "programme") -> DataFrame:
    """The programme's rows; if there are none, the query fails when it runs."""
    kept = df.where(F.col(column) == programme)
    empty = kept.select(F.lit(1).alias("_one")).limit(1).agg(F.count("_one").alias("_n"))
    checked = empty.select(F.when(F.col("_n") == 0, F.raise_error(F.lit(f"there is no programme {programme}")).cast("int")).otherwise(F.lit(1)).alias("_ok"))
    return kept.join(F.broadcast(checked), F.col("_ok") == 1).drop("_ok")  # one row


def without_duplicates(df: DataFrame, stream: Sequence[str], order: Sequence[str], same: Sequence[str]) -> DataFrame:
    """df without records that repeat the one before in `same`."""
    w = Window.partitionBy(*stream).orderBy(*order)
    now = F.struct(*same)
    return df.withColumn("_d", (F.row_number().over(w) > 1) & now.eqNullSafe(F.lag(now).over(w))).where(~F.col("_d")).drop("_d")


def one_unit(df: DataFrame, unit: int, column: str = "unit") -> DataFrame:
    return df.where(F.col(column) == unit)


def one_part(df: DataFrame, group: int, part: int) -> DataFrame:
    return df.where((F.col("group") == group) & (F.col("part") == part))


def presentation_kinds(masks: DataFrame, count: int = 4) -> DataFrame:
    """For presentations 0 to count - 1 (bit masks of substreams in columns m0, m1, ...): kind_k. One that uses substream k or a later one is carried: "downmix of i" if a later carried one (the nearest) reads substream k, else "independent". Others are "copy of i" of the nearest earlier carried one, or "invalid"."""
    carried = [F.shiftright(f"m{k}", k) != 0 for k in range(count)]
    out = masks
    for k in range(count):
        later, earlier = F.lit("independent"), F.lit("invalid")
        for i in reversed(range(k + 1, count)):
            later = F.when(carried[i] & (F.shiftright(f"m{i}", k).bitwiseAND(1) != 0), f"downmix of {i}").otherwise(later)
        for i in range(k):
            earlier = F.when(F.shiftright(f"m{k}", i) != 0, f"copy of {i}").otherwise(earlier)
        out = out.withColumn(f"kind_{k}", F.when(carried[k], later).otherwise(earlier))
    return out


def needed_parts(df: DataFrame, wanted: Column, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """The union of the masks of the wanted presentations."""
    return df.groupBy(*by).agg(F.coalesce(F.bit_or(F.when(wanted, F.col(mask))), F.lit(0)).alias("needed"))


def reads_part(mask: Column, part: Column) -> Column:
    """Whether a lane of this mask reads the part: prune the others' columns by it."""
    return F.getbit(mask.cast("long"), part.cast("int")) == 1


def channel_union(parts: Sequence[DataFrame], keys: Sequence[str], channels: Sequence[Sequence[str]]) -> DataFrame:
    """Rows of substreams side by side: substream k brings the columns channels[k]; a channel that several bring is the last one's, where it has it."""
    names = list(dict.fromkeys(c for cs in channels for c in cs))
    out = None
    for k, (df, cs) in enumerate(zip(parts, channels, strict=True)):
        part = df.select(*keys, *(F.col(c).alias(f"_{k}_{c}") for c in cs))
        out = part if out is None else out.join(part, list(keys), "full_outer")
    return out.select(*keys, *(F.coalesce(*(F.col(f"_{k}_{c}") for k in reversed(range(len(parts))) if c in channels[k])).alias(c) for c in names))


def member_exit_codes(members: DataFrame, failed: Column, faulty: Column, lossy: Column, name: str = "member") -> DataFrame:
    """Members by id, with the exit code of each: 2 if it failed, 7 if faulty, 4 if lossy, else 0."""
    return members.withColumn("exit_code", F.when(failed, 2).when(faulty, 7).when(lossy, 4).otherwise(0)).orderBy(name)


def output_name(stem: Column, kind: str, number: Column, suffix: str, several: Column) -> Column:
    """A member's file name: stem.suffix, or stem.kindN.suffix where there are several."""
    return F.when(several, F.concat(stem, F.lit(f".{kind}"), number.cast("string"), F.lit(f".{suffix}"))).otherwise(F.concat(stem, F.lit(f".{suffix}")))


def demux(df: DataFrame, kind: str, kinds: Sequence[str]) -> dict[str, DataFrame]:
    """An interleaved stream's records by kind, each in the order of the whole."""
    return {k: df.where(F.col(kind) == k) for k in kinds}


# -- ordered


def restart_judgement(units: DataFrame, stream: Sequence[str], unit: str, per_unit: int, most_75ms: int, fifo: str) -> DataFrame:
    """Each restart header (a unit with `output`) judged: duplicate, output_delta, and where the clock or the rate jumped (`judged`) the four conditions of a valid branch, and `valid`: all hold.

    units: input and output (16-bit clocks; output null where nothing restarts), words, peak, input_jump; units are numbered without gaps. Between restarts
    the advance grows by per_unit less the input's step, so it follows from the last restart alone.
    """
    w = Window.partitionBy(*stream).orderBy(unit)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("output").isNotNull(), F.struct(F.col(unit).alias("u"), F.col("output").alias("o"), F.col("input").alias("i")))
    marked = units.withColumn("_r", F.last(at, ignorenulls=True).over(past))
    marked = marked.withColumns({f"_{c}": F.lag(c).over(w) for c in ("input", "words", "peak", fifo)}).where("output is not null")
    expected = F.pmod(F.col("_r.o") + (F.col(unit) - F.col("_r.u")) * per_unit, F.lit(CLOCK))
    advance = F.pmod(F.col("output") - per_unit - F.col("input"), F.lit(CLOCK))
    # at the last restart, and what the units since have added
    before = F.pmod(F.col("_r.o") - per_unit - F.col("_r.i") + (F.col(unit) - 1 - F.col("_r.u")) * per_unit - F.col("_input") + F.col("_r.i"), F.lit(CLOCK))
    out = marked.withColumn("duplicate", F.coalesce(F.col("output") == F.col("_r.o"), F.lit(False))).withColumn("output_delta", F.pmod(F.col("output") - expected, F.lit(CLOCK)))
    out = out.withColumn("advance", advance).withColumn("prev_advance", F.coalesce(before, advance))
    out = out.withColumn("judged", F.col("_input").isNotNull() & (F.coalesce(F.col("output_delta") != 0, F.lit(False)) | F.col("input_jump") | (F.col("peak") != F.col("_peak"))))
    interval = F.pmod(F.lit(per_unit) + F.col("prev_advance") - F.col("advance"), F.lit(CLOCK))
    limit = F.col("prev_advance") + per_unit - F.col(f"_{fifo}")
    conditions = {
        "advance_step": F.col("advance") <= F.col("prev_advance") + 3 * (per_unit // 4),
        "fifo_duration": (limit >= 0) & (F.col("advance") <= limit),
        "within_75ms": F.lit(most_75ms >= per_unit) & (F.col("advance") <= most_75ms - per_unit),
        "data_rate": F.col("_words") * 256 <= F.col("_peak") * interval,
    }
    out = out.withColumns({k: F.when(F.col("judged"), (interval != 0) & F.coalesce(c, F.lit(False))) for k, c in conditions.items()})
    valid = F.lit(True)
    for k in conditions:
        valid = valid & F.col(k)
    return out.withColumn("valid", valid).select(*stream, unit, "duplicate", "output_delta", "advance", "prev_advance", "judged", *conditions, "valid")


def trace_delays(trace: DataFrame, stream: Sequence[str], unit: str, per_unit: int) -> DataFrame:
    """The delay of each unit from a trace (input, output or null): both clocks unwrapped, the output within half a clock of the input where it is stated, else per_unit after the last. Units before the first stated output have none."""
    w = Window.partitionBy(*stream).orderBy(unit)
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    step = trace.withColumn("_w", F.coalesce((F.col("input") + CLOCK // 2 < F.lag("input").over(w)).cast("long") * CLOCK, F.lit(0)))
    timed = step.withColumn("_t", F.col("input") + F.sum("_w").over(to_here))
    placed = F.col("_t") - F.pmod(F.col("_t"), F.lit(CLOCK)) + F.col("output")
    placed = placed + F.when(placed + CLOCK // 2 < F.col("_t"), CLOCK).when(placed > F.col("_t") + CLOCK // 2, -CLOCK).otherwise(0)
    known = timed.withColumn("_k", F.when(F.col("output").isNotNull(), F.struct(placed.alias("o"), F.col(unit).alias("u"))))
    last = known.withColumn("_l", F.last("_k", ignorenulls=True).over(to_here))
    return last.withColumn("delay", F.col("_l.o") + (F.col(unit) - F.col("_l.u")) * per_unit - F.col("_t")).select(*stream, unit, "delay")


def damage_scope(findings: DataFrame, scopes: DataFrame, rule: str, part: str, parts: Column) -> DataFrame:
    """findings with `scope` (by rule: audio, stream, metadata; none, if the rule names no damage) and `mask`: the finding's own part, or all parts of the stream where it names none or the scope is the whole stream."""
    everything = F.when(parts >= 8, F.lit(255)).otherwise((F.pow(F.lit(2), parts) - 1).cast("int"))
    own = F.when(F.col(part).isNull(), everything).otherwise(F.pow(F.lit(2), F.col(part)).cast("int"))
    out = findings.join(F.broadcast(scopes), rule, "left").withColumn("scope", F.coalesce("scope", F.lit("none")))  # a row for each rule of a catalog
    return out.withColumn("mask", F.when(F.col("scope") == "audio", own).when(F.col("scope") == "stream", everything).otherwise(F.lit(0)))


SPAN = 1024  # groups of a stream that one row of stalled_groups covers


def stalled_groups(parts: DataFrame, stream: Sequence[str], group: str, part: str, expected: Sequence[int]) -> DataFrame:
    """The parts that a group (an integer) waits for in vain: each expected part of each group from the stream's first to its last that has no row; `blocks`: whether a later group of the stream has that part.

    What is missing can be many times what is there, so it is never shuffled: the groups that have a part, in sets of at most SPAN, meet
    the stream's spans of SPAN groups, and only then the rest of each span is written out. No task needs a whole stream.
    """
    known = F.lit(True)
    for c in stream:
        known = known & F.col(c).isNotNull()  # a null is no stream that a part could be found in
    start = F.col(group) - F.pmod(F.col(group), F.lit(SPAN))
    ends = parts.groupBy(*stream).agg(F.min(group).alias("_a"), F.max(group).alias("_b"), *(F.max(F.when(known & (F.col(part) == p), F.col(group))).alias(f"_l{i}") for i, p in enumerate(expected)))
    first, last = (F.col(c) - F.pmod(F.col(c), F.lit(SPAN)) for c in ("_a", "_b"))
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, else few tasks would write a lot: what they read is small
    spans = ends.withColumn("_s", F.explode(F.sequence(first, last, F.lit(SPAN).cast(parts.schema[group].dataType)))).repartition(tasks, *stream, "_s")
    there = parts.where(F.col(part).isin(*expected)).groupBy(*stream, start.alias("_s")).agg(*(F.collect_set(F.when(F.col(part) == p, F.col(group))).alias(f"_g{i}") for i, p in enumerate(expected)))
    each = F.array(*(F.struct(F.lit(p).alias("p"), F.col(f"_l{i}").alias("l"), F.col(f"_g{i}").alias("g")) for i, p in enumerate(expected)))
    by_part = spans.join(there, [*stream, "_s"], "left").select(*stream, F.greatest("_a", "_s").alias("_from"), F.least(F.col("_b"), F.col("_s") + (SPAN - 1)).alias("_to"), F.explode(each).alias("_e"))
    wanted = F.sequence("_from", "_to")
    missing = F.when(F.col("_e.g").isNull(), wanted).otherwise(F.array_except(wanted, F.col("_e.g")))
    out = by_part.select(*stream, F.col("_e.p").alias(part), F.col("_e.l").alias("_last"), F.explode(missing).alias(group))
    return out.select(*stream, group, part, F.coalesce(F.col("_last") > F.col(group), F.lit(False)).alias("blocks"))


def layout_policy(df: DataFrame, stream: Sequence[str], order: Sequence[str], layout: str, policy: str) -> DataFrame:
    """What a delivery does as a stream's layout changes: "stop" keeps what comes before the first change; "fixed" keeps all, `fits` says whether a record has the first layout; "split" numbers the pieces of one layout in `piece`."""
    w = Window.partitionBy(*stream).orderBy(*order)
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    if policy == "fixed":
        return df.withColumn("fits", F.col(layout).eqNullSafe(F.first(layout).over(to_here)))
    changed = (F.row_number().over(w) > 1) & ~F.col(layout).eqNullSafe(F.lag(layout).over(w))
    pieces = df.withColumn("_c", changed.cast("int")).withColumn("piece", F.sum("_c").over(to_here)).drop("_c")
    if policy == "split":
        return pieces
    if policy != "stop":
        raise ValueError("the policy is stop, fixed or split")
    return pieces.where("piece = 0").drop("piece")


def groups_with_release(records: DataFrame, stream: Sequence[str], order: Sequence[str], kind: str, opener: str) -> DataFrame:
    """Groups that each `opener` begins: group, first, n, and released: "successor", or "end" for the last, which only the end of the stream lets go. Records before the first opener belong to none."""
    w = Window.partitionBy(*stream).orderBy(*order)
    numbered = records.withColumn("group", F.sum((F.col(kind) == opener).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("group > 0")
    out = numbered.groupBy(*stream, "group").agg(F.min(F.struct(*order)).alias("_f"), F.count(F.lit(1)).alias("n"))
    last = F.max("group").over(Window.partitionBy(*stream))
    return out.withColumn("released", F.when(F.col("group") == last, "end").otherwise("successor")).select(*stream, "group", *(F.col(f"_f.{c}").alias(f"first_{c}") for c in order), "n", "released")


# -- comparisons


def _leaves(value, path: str) -> Iterator[tuple[str, str, str]]:
    """(path, type, text) of a tree's leaves and of the lengths of its lists, without recursion."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            yield at, "object", ""
            stack += [(f"{at}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            yield at, "array", str(len(v))
            stack += [(f"{at}[{i}]", x) for i, x in enumerate(v)]
        else:
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string"
            yield at, kind, v if kind == "string" else json.dumps(v)


def json_tree(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, path, type, value) of every node of JSON texts, at any depth: an object has no value, an array its length. A text that is no JSON is one string; a null text has no rows."""
    kinds = [df.schema[k] for k in keys]
    names = [*keys, "path", "type", "value"]

    def walked(batches):
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                if text is None:
                    continue
                try:
                    tree = json.loads(text)
                except ValueError:
                    tree = text
                for leaf in _leaves(tree, "$"):
                    rows.append(i)
                    found.append(leaf)
            at = pa.array(rows, pa.int64())
            paths = [pa.array([f[k] for f in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *paths], names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "path string, type string, value string"])
    return df.select(*keys, F.col(column).cast("string").alias("_json")).mapInArrow(walked, schema)


def tree_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], ignore: Sequence[str] = (), additions: bool = True) -> DataFrame:
    """(keys, path, kind, a, b) of two json_tree tables: type, length, changed, removed, and (if additions count) added. Below a node that was added, removed or changed its type nothing is listed; paths that end with a name to ignore, or lie below one, neither."""
    for name in ignore:
        a, b = (x.where(~F.col("path").rlike(rf"\.{name}(\.|\[|$)")) for x in (a, b))
    sides = [x.select(*keys, "path", F.col("type").alias(f"_{n}t"), F.col("value").alias(n)) for x, n in ((a, "a"), (b, "b"))]
    joined = sides[0].join(sides[1], [*keys, "path"], "full_outer")
    kind = (
        F.when(F.col("_bt").isNull(), "removed").when(F.col("_at").isNull(), "added").when(F.col("_at") != F.col("_bt"), "type")
        .when(F.col("a") != F.col("b"), F.when(F.col("_at") == "array", "length").otherwise("changed"))
    )
    found = joined.withColumn("kind", kind).where("kind is not null")
    parent = F.regexp_replace("path", r"(\.[^.\[]*|\[\d+\])$", "")
    heads = found.select(*keys, F.col("path").alias("_parent"), F.col("kind").alias("_pk"))
    found = found.withColumn("_parent", parent).join(heads, [*keys, "_parent"], "left").where("_pk is null or _pk not in ('removed', 'added', 'type')").where("_pk is null or _pk <> 'length' or kind not in ('added', 'removed')")
    return found.where(F.lit(additions) | (F.col("kind") != "added")).select(*keys, "path", "kind", "a", "b")


def field_agreement(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Two reports field by field: key, a boolean agree_field for each (null equals null), and agrees: all do. A key that one lacks agrees in nothing."""
    joined = a.select(key, F.lit(True).alias("_a"), *(F.col(f).alias(f"_a_{f}") for f in fields)).join(b.select(key, F.lit(True).alias("_b"), *(F.col(f).alias(f"_b_{f}") for f in fields)), key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = joined.select(key, *((both & F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}"))).alias(f"agree_{f}") for f in fields))
    agrees = F.lit(True)
    for f in fields:
        agrees = agrees & F.col(f"agree_{f}")
    return out.withColumn("agrees", agrees)


def declared_pairs(a: DataFrame, b: DataFrame, label: str, ordinal: str, track: str, scene: str) -> DataFrame:
    """Tracks of scenes paired by what is declared, never by position: beds by label, objects (those without a label) by ordinal: scene, role, name, track_a, track_b (null without a counterpart)."""
    beds = [x.where(F.col(label).isNotNull()).select(scene, F.lit("bed").alias("role"), F.col(label).alias("name"), F.col(track).alias(n)) for x, n in ((a, "track_a"), (b, "track_b"))]
    objects = [x.where(F.col(label).isNull()).select(scene, F.lit("object").alias("role"), F.concat(F.lit("obj"), F.col(ordinal).cast("string")).alias("name"), F.col(track).alias(n)) for x, n in ((a, "track_a"), (b, "track_b"))]
    left, right = (x.unionByName(y) for x, y in zip(beds, objects, strict=True))
    return left.join(right, [scene, "role", "name"], "left")


def distortion_ratio(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of positional(): 20 log10 of b's RMS over the error's, in dB to two places; null where b is silent, infinite without error."""
    d = F.col("a") - F.col("b")
    sums = pairs.where("a is not null and b is not null").groupBy(*by).agg(F.avg(d * d).alias("_e"), F.avg(F.col("b") * F.col("b")).alias("_s"))
    return sums.select(*by, F.when(F.col("_s") == 0, None).when(F.col("_e") == 0, F.lit(float("inf"))).otherwise(F.round(20 * F.log10(F.sqrt("_s") / F.sqrt("_e")), 2)).alias("sdr_db"))


def parity_faults(a: DataFrame, b: DataFrame, key: str, equal: Sequence[str] = (), at_most: Sequence[str] = ()) -> DataFrame:
    """Invariants between two commands' results: rows (key, field, a, b) where a field that must be equal differs, or a's exceeds b's where it may not."""
    joined = a.select(key, *(F.col(f).cast("double").alias(f"_a_{f}") for f in (*equal, *at_most))).join(b.select(key, *(F.col(f).cast("double").alias(f"_b_{f}") for f in (*equal, *at_most))), key, "full_outer")
    rows = joined.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(f in equal).alias("e"), F.col(f"_a_{f}").alias("a"), F.col(f"_b_{f}").alias("b")) for f in (*equal, *at_most)))).alias("_r")).select(key, "_r.*")
    broken = F.when(F.col("e"), ~F.col("a").eqNullSafe(F.col("b"))).otherwise(F.coalesce(F.col("a") > F.col("b"), F.lit(True)))
    return rows.where(broken).drop("e")


def small_side(splits: DataFrame, yes: str = "yes", no: str = "no", enough: int = 10) -> DataFrame:
    """splits with `ways`: in how many ways the smaller side could be chosen from all rows (C(n, k)), null where it has `enough` rows: a split of so few may be chance."""
    k = F.least(yes, no).cast("long")
    n = (F.col(yes) + F.col(no)).cast("decimal(38,0)")
    steps = F.when((k > 0) & (k < enough), F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    ways = F.aggregate(steps, F.lit(1).cast("decimal(38,0)"), lambda x, i: F.floor(x.cast("double") * (n - i + 1).cast("double") / i.cast("double") + 0.5).cast("decimal(38,0)"))
    return splits.withColumn("ways", F.when(k < enough, ways))


# -- catalogs and text


def in_catalog_order(tallied: DataFrame, catalog: DataFrame, rule: str, position: str) -> DataFrame:
    """Tallies in the order of their rules in the catalog; rules that it lacks come last, by name."""
    return tallied.join(F.broadcast(catalog.select(rule, position)), rule, "left").orderBy(F.col(position).asc_nulls_last(), rule)  # a row for each rule of a catalog


def catalog_markdown(catalog: DataFrame, position: str, columns: Sequence[str]) -> DataFrame:
    """The catalog as the lines of a Markdown table: line (from 0), text. Bars in the cells are escaped."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in columns]
    body = catalog.select((F.row_number().over(Window.orderBy(position)) + 1).alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("text"))
    head = catalog.sparkSession.createDataFrame([(0, f"| {' | '.join(columns)} |"), (1, f"|{'---|' * len(columns)}")], "line int, text string")
    return head.unionByName(body).orderBy("line")


def text_report(report: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A report as lines of text, one for each field that has a value: key, line, text ("field: value")."""
    lines = F.filter(F.array(*(F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f).cast("string"))) for f in fields)), lambda x: x.isNotNull())
    return report.select(key, F.posexplode(lines).alias("line", "text"))


# -- scalars

# Names of horizontal zones by code, of warp modes by code, and of channels with their other spellings.
WARPS = {0: "normal", 1: "warping", 2: "ProLogicIIx", 3: "LoRo"}
ZONES = {1: "no back", 2: "no sides", 3: "center back", 4: "screen only", 5: "surround only"}
OTHER_NAMES = {"Lb": "Lrs", "Rb": "Rrs"}
CHANNELS = ("L", "C", "R", "Ls", "Rs", "Lc", "Rc", "Lrs", "Rrs", "Cs", "Ts", "Lsd", "Rsd", "Lw", "Rw", "Vhl", "Vhr", "Vhc", "Lts", "Rts", "LFE2", "LFE", "Ch1", "Ch2", "S")


def _of(names: Mapping, key: Column, otherwise: str | None = None) -> Column:
    items = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*items), key), F.lit(otherwise))


def zones_name(code: Column) -> Column:
    return _of(ZONES, code, "all")


def warp_name(code: Column) -> Column:
    """Null of a code that has no name, or of a payload that declares none."""
    return _of(WARPS, code)


def channel_name(name: Column) -> Column:
    """The standard's name of a channel, from it or another spelling; null of an unknown one."""
    return _of({c: c for c in CHANNELS} | OTHER_NAMES, name)


def room_position(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """From a room of 0 to 1 (front to back) to one of -1 to 1 (back to front); the height stays."""
    return (x - 0.5) * 2.0, (F.lit(0.5) - y) * 2.0, z


def snr_offset(coarse: Column, fine: Column) -> Column:
    """((coarse - 15) * 16 + fine) * 4."""
    return ((coarse.cast("int") - 15) * 16 + fine.cast("int")) * 4


def disc_fit(facts: DataFrame) -> DataFrame:
    """facts (fba, rate, channels: widest presentation, both: two- and six-channel presentations there, marked, peak, late: delivery bounds broken) with, for each of blu_ray, hd_dvd and dvd_audio, why it does not fit (an array, empty if it does) and fits_*: yes, no, or unjudged."""
    fba, rate, wide = F.col("fba"), F.col("rate"), F.col("channels")
    high = rate.isin(176_400, 192_000)
    late = F.when(fba & F.col("late"), "delivery")
    reasons = {
        "blu_ray": (F.when(~fba, "syntax"), F.when(~rate.isin(48_000, 96_000, 192_000), "rate"), F.when((rate == 192_000) & (wide > 6), "channels"), late),
        "hd_dvd": (F.when(high & (wide > 2), "channels"), F.when(~fba & ~F.col("both"), "presentations"), late),
        "dvd_audio": (F.when(fba, "syntax"), F.when(~fba & ~F.col("marked"), "mark"), F.when(~fba & high & (wide > 2), "channels"), F.when(~fba & (F.col("peak") > 9_600_000), "peak")),
    }
    out = facts
    for disc, why in reasons.items():
        out = out.withColumn(f"not_{disc}", F.array_compact(F.array(*why)))
        unknown = F.lit(disc == "hd_dvd") & (rate % 44_100 == 0)
        out = out.withColumn(f"fits_{disc}", F.when(F.size(f"not_{disc}") > 0, "no").when(unknown, "unjudged").otherwise("yes"))
    return out


# -- every member in one pass


def write_members(df: DataFrame, member: str, order: Sequence[str], folder: str) -> DataFrame:
    """Writes each member's records to a folder of its own (member=...), in order within its files, all from one pass; returns member, records, in the members' order."""
    df.repartition(F.col(member)).sortWithinPartitions(member, *order).write.partitionBy(member).parquet(folder)
    return df.sparkSession.read.parquet(folder).groupBy(member).agg(F.count(F.lit(1)).alias("records")).orderBy(member)
