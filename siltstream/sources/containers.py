"""Metadata containers (ETSI TS 102 366, annex H): found by their sync word in a run of bytes, read, and written.

A container names payloads by id, each with a configuration and its bytes, and ends with protection bits. The walk
looks for sync words byte by byte; behind a container that could be read it goes on after it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import BitReader, BitWriter

# Fixed values of the standard: the sync word, and bits of protection by code.
SYNC = b"\x58\x38"
PROTECTION = (0, 8, 32, 128)


@dataclass
class Payload:
    id: int
    data: bytes
    sample_offset: int | None = None
    duration: int | None = None
    group: int | None = None
    codec: int | None = None
    discard: bool = True
    aligned: bool = False
    duplicate: int = 0  # two bits: create, remove
    priority: int = 0
    allowed: int = 0


@dataclass
class Container:
    version: int = 0
    key: int = 0
    payloads: list[Payload] = field(default_factory=list)
    primary: int = 1
    secondary: int = 0
    protection: bytes = b"\0"


def _more(r: BitReader, n: int) -> int:
    """A field of n bits; all ones are followed by a variable rest."""
    v = r.read(n)
    return v + r.variable(n) if v == (1 << n) - 1 else v


def read_container(r: BitReader) -> Container:
    out = Container(_more(r, 2), _more(r, 3))
    while number := _more(r, 5):
        p = Payload(number, b"")
        if r.read(1):
            p.sample_offset = r.read(11)
            r.read(1)
        if r.read(1):
            p.duration = r.variable(11)
        if r.read(1):
            p.group = r.variable(2)
        if r.read(1):
            p.codec = r.read(8)
        p.discard = bool(r.read(1))
        if not p.discard:
            if p.sample_offset is None and r.read(1):
                p.aligned, p.duplicate = True, r.read(2)
            if p.sample_offset is not None or p.aligned:
                p.priority, p.allowed = r.read(5), r.read(2)
        p.data = r.bytes(r.variable(8))
        out.payloads.append(p)
    out.primary, out.secondary = r.read(2), r.read(2)
    if out.primary == 0:
        raise ValueError("the primary protection's length is reserved")
    out.protection = r.bytes((PROTECTION[out.primary] + PROTECTION[out.secondary]) // 8)
    return out


def _write_more(w: BitWriter, value: int, n: int) -> None:
    top = (1 << n) - 1
    w.write(min(value, top), n)
    if value >= top:
        w.variable(value - top, n)


def write_container(c: Container) -> bytes:
    """The container with its sync word and length."""
    w = BitWriter()
    _write_more(w, c.version, 2)
    _write_more(w, c.key, 3)
    for p in c.payloads:
        _write_more(w, p.id, 5)
        w.write(p.sample_offset is not None, 1)
        if p.sample_offset is not None:
            w.write(p.sample_offset, 11).write(0, 1)
        w.write(p.duration is not None, 1)
        if p.duration is not None:
            w.variable(p.duration, 11)
        w.write(p.group is not None, 1)
        if p.group is not None:
            w.variable(p.group, 2)
        w.write(p.codec is not None, 1)
        if p.codec is not None:
            w.write(p.codec, 8)
        w.write(p.discard, 1)
        if not p.discard:
            if p.sample_offset is None:
                w.write(p.aligned, 1)
                if p.aligned:
                    w.write(p.duplicate, 2)
            if p.sample_offset is not None or p.aligned:
                w.write(p.priority, 5).write(p.allowed, 2)
        w.variable(len(p.data), 8)
        for b in p.data:
            w.write(b, 8)
    w.write(0, 5).write(c.primary, 2).write(c.secondary, 2)
    for b in c.protection:
        w.write(b, 8)
    body = w.bytes()
    return SYNC + len(body).to_bytes(2, "big") + body


def walk(data: bytes) -> Iterator[tuple[int, Container | None, str | None]]:
    """(place, container, None) or (place, None, why not) for each sync word in data, from left to right."""
    at = data.find(SYNC)
    while at >= 0:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        step = 1
        try:
            if len(body) < size or not size:
                raise EOFError("the container is cut off")
            r = BitReader(body)
            found = read_container(r)
            if (r.at + 7) // 8 != size:
                raise ValueError("the declared length isn't the container's")
            yield at, found, None
            step = 4 + size
        except (EOFError, ValueError) as e:
            yield at, None, str(e)
        at = data.find(SYNC, at + step)


FIELDS = "at long, error string, version long, key long, primary_code int, secondary_code int, number int, payload_id long, sample_offset int, duration long, payload_group long, bytes binary"


def containers_of(df: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """keys and a row for each payload of each container in a binary column (a container without payloads, and a sync word where none can be read, have one row, without payload): place, error, the container's version, key and protection codes, the payload's number, id, configuration and bytes."""
    names = [*keys, *(f.split()[0] for f in FIELDS.split(", "))]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def walked(batches):
        for batch in batches:
            rows, out = [], []
            for i, data in enumerate(batch.column(len(keys))):
                for at, c, why in walk(data.as_py() or b""):
                    head = (at, why, *((c.version, c.key, c.primary, c.secondary) if c else (None,) * 4))
                    for k, p in enumerate(c.payloads if c and c.payloads else [None]):
                        rows.append(i)
                        out.append((*head, *((k, p.id, p.sample_offset, p.duration, p.group, p.data) if p else (None,) * 6)))
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), FIELDS])
    return df.select(*keys, F.col(content).cast("binary").alias("_content")).mapInArrow(walked, schema)


def authored(df: DataFrame, keys: Sequence[str], noise: str | None = None) -> DataFrame:
    """keys and `content`: for each row a container of one payload, from the columns version, key, payload_id, sample_offset, duration, payload_group (these three may be null) and bytes; behind the bytes of the column `noise`, if there is one."""
    names = ["version", "key", "payload_id", "sample_offset", "duration", "payload_group", "bytes"]

    def written(batches):
        for batch in batches:
            n = len(keys)
            out = []
            for *v, lead in zip(*(batch.column(n + k).to_pylist() for k in range(len(names) + 1)), strict=True):
                version, key, number, offset, duration, group, data = v
                out.append((lead or b"") + write_container(Container(version, key, [Payload(number, data, offset, duration, group)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.binary())], [*keys, "content"])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "content binary"])
    lead = F.col(noise) if noise else F.lit(None).cast("binary")
    return df.select(*keys, *names, lead.alias("_noise")).mapInArrow(written, schema)
