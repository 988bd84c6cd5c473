"""Access units of lossless streams: locked on by a verified major sync, then walked by length.

A unit is 4 bits of parity, 12 bits of length in words and 16 bits of input timing, perhaps a major
sync, a directory of substreams (2 bytes each, 4 with the extra word) and the substreams. The parity is
over the header and the directory. A length under 4 bytes, a failed parity or a major sync whose checksum fails
loses the lock; the search goes on one byte further, for a unit whose major sync is verified.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import crc16_after_shift
from .bits import BitReader, BitWriter

# Fixed values of the format: the major syncs of the two kinds of stream, and their least length.
SYNCS = (b"\xf8\x72\x6f\xba", b"\xf8\x72\x6f\xbb")
LEAST = 28
#: The largest unit: 4095 words.
LARGEST = 8190


@dataclass
class Unit:
    offset: int
    data: bytes
    timing: int
    major_sync: bool
    resynced: bool
    gap: int  # bytes skipped before it
    crc_failures: int  # of major syncs in the gap
    gap_only: bool = False  # what was skipped at the end, no unit


def major_sync(data: bytes) -> tuple[int, int] | None:
    """(length, substreams) of a major sync that begins here and whose checksum holds."""
    if len(data) < LEAST or data[:4] not in SYNCS:
        return None
    size = LEAST
    if data[3] == SYNCS[0][3] and data[25] & 1:
        size += 2 + 2 * (data[26] >> 4)
    if len(data) < size or crc16_after_shift(data[: size - 2]) != int.from_bytes(data[size - 2 : size], "big"):
        return None
    return size, data[16] >> 4


def _parity(unit: bytes, sync: int, substreams: int) -> bool:
    at, x = 4 + sync, 0
    for _ in range(substreams):
        at += 4 if at < len(unit) and unit[at] & 0x80 else 2
    if at > len(unit):
        return False
    for b in unit[:4] + unit[4 + sync : at]:
        x ^= b
    return (x ^ x >> 4) & 15 == 15


def units(stream: io.BufferedIOBase, block: int = 4 << 20) -> Iterator[Unit]:
    """The units of a stream, whatever the size of the blocks that it is read in."""
    buffer, base, at, ended = b"", 0, 0, False
    substreams = 0  # 0: not locked
    lost, failures, resynced = None, 0, False

    def lose():
        nonlocal lost, substreams
        if lost is None:
            lost = base + at
        substreams = 0

    while True:
        while not ended and len(buffer) - at < 2 * LARGEST:
            more = stream.read(block)
            ended = not more
            base, buffer, at = base + at, buffer[at:] + more, 0
        if at >= len(buffer):
            break
        size = 2 * ((buffer[at] & 15) << 8 | buffer[at + 1]) if at + 2 <= len(buffer) else 0
        unit = buffer[at : at + size]
        sync = None
        begins = unit[4:8] in SYNCS
        if begins:
            sync = major_sync(unit[4:])
            failures += sync is None
        n = sync[1] if sync else substreams
        if size < 4 or len(unit) < size or begins and not sync or not n or not _parity(unit, sync[0] if sync else 0, n):
            lose()
            # the next place where a unit with a major sync can begin
            found = [k for s in SYNCS if (k := buffer.find(s, at + 5)) >= 0]
            at = min(found) - 4 if found else len(buffer) if ended else max(at + 1, len(buffer) - 7)
            resynced = True
            continue
        offset = base + at
        yield Unit(offset, unit, unit[2] << 8 | unit[3], bool(sync), resynced, 0 if lost is None else offset - lost, failures)
        substreams, lost, failures, resynced = n, None, 0, False
        at += size
    if lost is not None:
        yield Unit(base + len(buffer), b"", 0, False, False, base + len(buffer) - lost, failures, True)


def units_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, unit, offset, kind (unit, or trailing for what is skipped at the end), bytes, timing, major_sync, resynced, gap (bytes before it), crc_failures, from a binaryFile table."""
    schema = pa.schema([("path", pa.string()), ("unit", pa.int64()), ("offset", pa.int64()), ("kind", pa.string()), ("bytes", pa.binary()), ("timing", pa.int64()), ("major_sync", pa.bool_()), ("resynced", pa.bool_()), ("gap", pa.int64()), ("crc_failures", pa.int64())])

    def scanned(batches):
        for batch in batches:
            for p, data in zip(batch.column(0), batch.column(1), strict=True):
                found = list(units(io.BytesIO(data.as_py() or b"")))
                columns = zip(*((p.as_py(), k, u.offset, "trailing" if u.gap_only else "unit", u.data, u.timing, u.major_sync, u.resynced, u.gap, u.crc_failures) for k, u in enumerate(found)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns if found else [[]] * len(schema), schema, strict=True)], schema=schema)

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInArrow(scanned, "path string, unit long, offset long, kind string, bytes binary, timing long, major_sync boolean, resynced boolean, gap long, crc_failures long")


# -- headers

RATE_NONE = 15


def unit_header(data) -> dict:
    """The first four bytes of a unit, as columns: check_nibble, length (bytes), timing. data: a binary column."""
    word = F.conv(F.hex(F.substring(data, 1, 4)), 16, 10).cast("long")
    return {"check_nibble": F.shiftright(word, 28).cast("int"), "length": (F.shiftright(word, 16).bitwiseAND(4095) * 2).cast("int"), "timing": word.bitwiseAND(65_535).cast("int")}


@dataclass
class Segment:
    """A directory's entry: where a substream ends (bytes from the directory's end), and its flags."""

    end: int
    extra_word: bool
    restart: bool
    crc: bool
    gain: int | None  # the extra word's upper bits


def directory(unit: bytes, sync: int, substreams: int) -> list[Segment]:
    """The directory behind a unit's header and major sync (of `sync` bytes)."""
    at, out = 4 + sync, []
    for _ in range(substreams):
        if at + 2 > len(unit):
            raise EOFError("the directory is cut off")
        word = unit[at] << 8 | unit[at + 1]
        at += 2
        extra = bool(word & 0x8000)
        more = int.from_bytes(unit[at : at + 2], "big") >> 7 if extra else None
        at += 2 * extra
        out.append(Segment(2 * (word & 0xFFF), extra, not word & 0x4000, bool(word & 0x2000), more))
    return out


@dataclass
class StreamConfig:
    syntax: str  # fba or fbb
    rate: int
    samples: int  # of a unit
    flags: int
    variable: bool
    peak: int  # bits a second
    substreams: int
    substream_info: int


def stream_config(sync: bytes) -> StreamConfig:
    """What a major sync says of its stream."""
    code = sync[4] >> 4
    if code == RATE_NONE or code & 7 > 2:
        raise ValueError("no sampling rate has this code")
    rate = (44_100 if code & 8 else 48_000) << (code & 7)
    word = sync[14] << 8 | sync[15]
    return StreamConfig("fba" if sync[3] == 0xBA else "fbb", rate, 40 << (code & 7), sync[10] << 8 | sync[11], bool(word & 0x8000), ((word & 0x7FFF) * rate + 8) >> 4, sync[16] >> 4, sync[17])


def configs_of(df: DataFrame, keys: list[str], sync: str) -> DataFrame:
    """keys and the configuration that each major sync in a binary column declares; nulls where its code names no rate."""
    names = ["syntax", "rate", "samples", "flags", "variable", "peak", "substreams", "substream_info"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]

    def read(batches):
        for batch in batches:
            rows = []
            for data in batch.column(len(keys)):
                try:
                    c = stream_config(data.as_py() or b"")
                    rows.append(tuple(getattr(c, n) for n in names))
                except (ValueError, IndexError):
                    rows.append((None,) * len(names))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keys, *names])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "syntax string, rate long, samples long, flags long, variable boolean, peak long, substreams long, substream_info long"])
    return df.select(*keys, F.col(sync)).mapInArrow(read, schema)


# -- restart headers

RESTART = 0x31EA >> 1


@dataclass
class RestartHeader:
    noise_type: int
    output: int  # timing
    first: int  # channels
    last: int
    last_matrixed: int
    noise_shift: int
    seed: int
    max_shift: int
    max_lsbs: int
    max_bits: int
    check: int | None  # the lossless check word, where it holds
    order: list[int]


def restart_header(r: BitReader) -> RestartHeader:
    """The header that begins here; ValueError if it isn't one, or its channels don't fit."""
    if r.read(13) != RESTART:
        raise ValueError("no restart header begins here")
    out = RestartHeader(r.read(1), r.read(16), r.read(4), r.read(4), r.read(4), r.read(4), r.read(23), r.read(4), r.read(5), r.read(5), None, [])
    if r.read(5) != out.max_bits:
        raise ValueError("the two widths differ")
    present, word = r.read(1), r.read(8)
    out.check = word if present else None
    r.read(16)
    if out.first > out.last or out.last > out.last_matrixed:
        raise ValueError("the channels are out of order")
    out.order = [r.read(6) for _ in range(out.last_matrixed + 1)]
    if sorted(out.order) != list(range(out.last_matrixed + 1)):
        raise ValueError("a channel is assigned twice, or none")
    r.read(8)
    return out


def write_restart(h: RestartHeader) -> bytes:
    w = BitWriter().write(RESTART, 13).write(h.noise_type, 1).write(h.output, 16).write(h.first, 4).write(h.last, 4).write(h.last_matrixed, 4).write(h.noise_shift, 4).write(h.seed, 23)
    w.write(h.max_shift, 4).write(h.max_lsbs, 5).write(h.max_bits, 5).write(h.max_bits, 5).write(h.check is not None, 1).write(h.check or 0, 8).write(0, 16)
    for k in h.order:
        w.write(k, 6)
    return w.write(0, 8).bytes()


def repaired(unit: bytes, substreams: int) -> tuple[bytes, bool, bool]:
    """The unit with its major sync's checksum and its parity nibble made right, and which of them was wrong. substreams: of the stream, where the unit has no major sync."""
    out, sync = bytearray(unit), 0
    wrong_sum = False
    if bytes(out[4:8]) in SYNCS and len(out) >= 4 + LEAST:
        sync = LEAST
        if out[7] == SYNCS[0][3] and out[29] & 1:
            sync += 2 + 2 * (out[30] >> 4)
        substreams = out[20] >> 4
        right = crc16_after_shift(bytes(out[4 : 4 + sync - 2])).to_bytes(2, "big")
        wrong_sum = bytes(out[4 + sync - 2 : 4 + sync]) != right
        out[4 + sync - 2 : 4 + sync] = right
    wrong_parity = not _parity(bytes(out), sync, substreams)
    if wrong_parity:
        for nibble in range(16):
            out[0] = nibble << 4 | out[0] & 15
            if _parity(bytes(out), sync, substreams):
                break
        else:
            raise ValueError("the directory is cut off")
    return bytes(out), wrong_sum, wrong_parity


# -- filters

@dataclass
class Filter:
    order: int
    shift: int
    coefficients: list[int]
    state: list[int]


def read_filter(r: BitReader, most_order: int, states: bool) -> Filter:
    """A prediction filter's coefficients (states: an IIR filter may bring its state); ValueError where a field is out of its range."""
    order = r.read(4)
    if order > most_order:
        raise ValueError(f"a filter of order {order}, where {most_order} is the most")
    if not order:
        return Filter(0, 0, [], [])
    shift, bits, coarse = r.read(4), r.read(5), r.read(3)
    if not 1 <= bits <= 16:
        raise ValueError(f"coefficients of {bits} bits")
    if bits + coarse > 16:
        raise ValueError("coefficients of more than 16 bits with their shift")
    coefficients = [r.signed(bits) << coarse for _ in range(order)]
    state = []
    if r.read(1):
        if not states:
            raise ValueError("this filter can't bring a state")
        wide, up = r.read(4), r.read(4)
        state = [r.signed(wide) << up if wide else 0 for _ in range(order)]
    return Filter(order, shift, coefficients, state)
