"""The ordered operators on streams: tallies, changes, groups and regions that don't depend on how the input was cut into batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_tally(findings: DataFrame, rule: str, magnitude: Column) -> DataFrame:
    """Count and magnitude by rule of all that came so far (output mode complete or update)."""
    return findings.groupBy(rule).agg(F.count(F.lit(1)).alias("count"), F.sum(magnitude).alias("magnitude"))


def windowed_tally(findings: DataFrame, rule: str, at: str, width: str, late: str) -> DataFrame:
    """Counts by rule and window; what comes later than `late` is left out."""
    return findings.withWatermark(at, late).groupBy(F.window(at, width), rule).agg(F.count(F.lit(1)).alias("count"))


def _typed(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def change_stream(updates: DataFrame, element: str, order: str, state: str) -> DataFrame:
    """The updates at which an element's state changes (its first too), with the state before. Updates of an element arrive in order; the last state is all that is kept."""
    kind = updates.schema[state].dataType.simpleString()

    def changed(key, pdfs: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        known, last = (True, kept.get[0]) if kept.exists else (False, None)
        out = []
        for row in pd.concat(list(pdfs)).sort_values(order, kind="stable").itertuples(index=False):
            now = getattr(row, state)
            now = None if pd.isna(now) else now
            if not known or now != last:
                out.append((key[0], getattr(row, order), now, last))
            known, last = True, now
        kept.update((last,))
        yield pd.DataFrame(out, columns=[element, order, state, f"previous_{state}"])

    return updates.select(element, order, state).groupBy(element).applyInPandasWithState(changed, f"{_typed(updates, [element, order, state])}, previous_{state} {kind}", f"last {kind}", "append", GroupStateTimeout.NoTimeout)


def group_stream(records: DataFrame, stream: str, order: str, kind: str, opener: str, end: str | None = None) -> DataFrame:
    """Groups of records: one of kind `opener` closes the open group and begins the next; a group comes out when it is closed: stream, group, first, n, kinds. Records before the first opener are orphans and don't come out. A record of kind `end` says that the stream is over: it lets the open group go and is no record itself."""

    def merged(key, pdfs: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        number, first, n, kinds = kept.get if kept.exists else (0, -1, 0, "")
        out = []
        for row in pd.concat(list(pdfs)).sort_values(order, kind="stable").itertuples(index=False):
            if end is not None and getattr(row, kind) == end:
                if number and n:
                    out.append((key[0], number, first, n, kinds))
                n = 0
            elif getattr(row, kind) == opener:
                if number and n:
                    out.append((key[0], number, first, n, kinds))
                number, first, n, kinds = number + 1, int(getattr(row, order)), 1, opener
            elif number and n:
                n, kinds = n + 1, f"{kinds},{getattr(row, kind)}"
        kept.update((number, first, n, kinds))
        yield pd.DataFrame(out, columns=[stream, "group", "first", "n", "kinds"])

    return records.select(stream, order, kind).groupBy(stream).applyInPandasWithState(merged, f"{_typed(records, [stream])}, group long, first long, n long, kinds string", "number long, first long, n long, kinds string", "append", GroupStateTimeout.NoTimeout)


def region_stream(units: DataFrame, stream: str, unit: str, damaged: str, restarted: str, end: str | None = None) -> DataFrame:
    """Damage regions by parts (bit masks), each when its last damaged part has restarted: as until_all_restart. A region still open comes out, without entry, when a unit has true in the column `end`: it is the stream's last."""

    def closed(key, pdfs: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        first, last, left, seen = kept.get if kept.exists else (-1, -1, 0, 0)
        out = []
        for row in pd.concat(list(pdfs)).sort_values(unit, kind="stable").itertuples(index=False):
            at, bad, new = int(getattr(row, unit)), int(getattr(row, damaged) or 0), int(getattr(row, restarted) or 0)
            if left and new & left & ~bad:
                left &= ~new
                if not left:
                    out.append((key[0], first, max(last, at - 1), at, seen))
                    first, seen = -1, 0
            if bad:
                first, last, left, seen = first if left else at, at, left | bad, seen | bad
            if end is not None and getattr(row, end) and left:
                out.append((key[0], first, at, None, seen))
                first, last, left, seen = -1, -1, 0, 0
        kept.update((first, last, left, seen))
        yield pd.DataFrame(out, columns=[stream, "first_unit", "last_unit", "entry_unit", "parts"]).astype({"entry_unit": "Int64"})

    return units.select(stream, unit, damaged, restarted, *([end] if end else [])).groupBy(stream).applyInPandasWithState(closed, f"{_typed(units, [stream])}, first_unit long, last_unit long, entry_unit long, parts long", "first long, last long, remaining long, seen long", "append", GroupStateTimeout.NoTimeout)


def in_order(parts: Sequence[tuple[int, DataFrame]], order: Sequence[str]) -> DataFrame:
    """Findings, events and samples of one unit in this order: each part with its rank, then by the order columns."""
    out = None
    for rank, df in parts:
        df = df.withColumn("part", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.orderBy(order[0], "part", *order[1:])
