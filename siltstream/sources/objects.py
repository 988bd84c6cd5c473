"""Object audio: tracks of CAF files, the chna chunk, and scenes written as ADM XML (ITU-R BS.2076, BS.2088) and as event text."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import timecode_text
from .media import caf_chunks, riff_chunks


@dataclass
class CafFormat:
    rate: float
    channels: int
    bits: int
    little: bool
    floats: bool
    offset: int  # of the first sample
    frames: int


def caf_format(data: bytes) -> CafFormat:
    """From the desc and data chunks of a CAF file of linear PCM; ValueError of another."""
    chunks = {name: (at, size) for name, at, size in caf_chunks(data)}
    if "desc" not in chunks or "data" not in chunks:
        raise ValueError("no CAF file with a description and data")
    rate, kind, flags, packet, per_packet, channels, bits = struct.unpack_from(">d4sIIIII", data, chunks["desc"][0])
    if kind != b"lpcm" or not channels or per_packet != 1 or packet != channels * bits // 8:
        raise ValueError("the samples aren't plain linear PCM")
    at, size = chunks["data"]
    return CafFormat(rate, channels, bits, bool(flags & 2), bool(flags & 1), at + 4, max(0, (size - 4) // packet))


def caf_track(data: bytes, channel: int) -> np.ndarray:
    """One channel's samples: 24-bit whole numbers (16 bits times 256, 32 bits over 256 rounded down), or floats."""
    f = caf_format(data)
    if not 0 <= channel < f.channels:
        raise IndexError(f"there are {f.channels} channels")
    size = f.bits // 8
    raw = np.frombuffer(data, np.uint8, f.frames * f.channels * size, f.offset).reshape(f.frames, f.channels, size)[:, channel]
    raw = np.ascontiguousarray(raw if f.little else raw[:, ::-1])
    if f.floats:
        return raw.view(f"<f{size}").reshape(-1)
    wide = np.zeros((f.frames, 4), np.uint8)
    wide[:, 4 - size :] = raw  # the most significant byte at the top: the sign comes with it
    return wide.view("<i4").reshape(-1) >> 8


@dataclass
class Uid:
    track: int
    uid: str
    track_format: str
    pack_format: str


def read_chna(data: bytes) -> list[Uid]:
    """The audio track UIDs of a chna chunk's body; unused rows (track 0) are left out. ValueError if its counts don't fit."""
    tracks, n = struct.unpack_from("<HH", data)
    if len(data) < 4 + 40 * n:
        raise ValueError("the chunk is shorter than its count of UIDs")
    rows = (struct.unpack_from("<H12s14s11sx", data, 4 + 40 * k) for k in range(n))
    out = [Uid(t, *(x.rstrip(b"\0").decode("ascii") for x in names)) for t, *names in rows if t]
    if len({u.track for u in out}) != tracks:
        raise ValueError("the chunk names another number of tracks")
    return out


def write_chna(uids: Sequence[Uid]) -> bytes:
    rows = b"".join(struct.pack("<H12s14s11sx", u.track, u.uid.encode(), u.track_format.encode(), u.pack_format.encode()) for u in uids)
    return struct.pack("<HH", len({u.track for u in uids}), len(uids)) + rows


def chna_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, track, uid, track_format, pack_format of the chna chunks of RIFF files, from a binaryFile table."""

    def scanned(batches):
        for batch in batches:
            rows = []
            for p, data in zip(batch.column(0), batch.column(1), strict=True):
                data = data.as_py() or b""
                for name, at, size in riff_chunks(data):
                    if name == "chna":
                        rows += [(p.as_py(), u.track, u.uid, u.track_format, u.pack_format) for u in read_chna(data[at : at + size])]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "track", "uid", "track_format", "pack_format"])

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(scanned, "path string, track int, uid string, track_format string, pack_format string")


def split_events(events: DataFrame, element: str, order: Sequence[str], bed: str, state: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(events of objects, losses): a scene's blocks hold objects only, so each change of a bed's state after its first is a loss: element, and how many."""
    w = Window.partitionBy(element).orderBy(*order)
    now = F.struct(*state)
    beds = events.where(F.col(bed)).withColumn("_n", F.row_number().over(w)).withColumn("_c", ~now.eqNullSafe(F.lag(now).over(w)))
    return events.where(~F.col(bed)), beds.where("_n > 1 and _c").groupBy(element).agg(F.count(F.lit(1)).alias("losses"))


def block_xml(blocks: DataFrame, rate: int) -> DataFrame:
    """blocks (channel: 8 hexadecimal digits, block, start, duration in samples, x, y, z, gain) with `xml`: each one's audioBlockFormat."""
    number = lambda c: F.expr(f"format_number(cast({c} as double), '0.######')")
    name = F.concat(F.lit("AB_"), F.col("channel"), F.lit("_"), F.lower(F.lpad(F.hex(F.col("block").cast("long")), 8, "0")))
    position = [F.concat(F.lit(f'<position coordinate="{c.upper()}">'), number(c), F.lit("</position>")) for c in ("x", "y", "z")]
    gain = F.when(F.col("gain") != 1, F.concat(F.lit("<gain>"), number("gain"), F.lit("</gain>"))).otherwise(F.lit(""))
    return blocks.withColumn(
        "xml",
        F.concat(
            F.lit('<audioBlockFormat audioBlockFormatID="'), name, F.lit('" rtime="'), timecode_text(F.col("start"), rate), F.lit('" duration="'), timecode_text(F.col("duration"), rate),
            F.lit('">'), F.lit("<cartesian>1</cartesian>"), *position, gain, F.lit("</audioBlockFormat>"),
        ),
    )


def write_adm(blocks: DataFrame, rate: int, out, programme: str = "programme") -> int:
    """Writes a scene's XML to a text file: a channel format for each channel, with its blocks in order; returns how many blocks. The blocks are sorted by tasks and come to the driver a partition at a time."""
    n, last = 0, None
    out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<audioFormatExtended><audioProgramme audioProgrammeID="APR_1001" audioProgrammeName={quoteattr(programme)}/>\n')
    for r in block_xml(blocks, rate).orderBy("channel", "block").select("channel", "xml").toLocalIterator():
        if r.channel != last:
            out.write(f'{"</audioChannelFormat>" if last else ""}\n<audioChannelFormat audioChannelFormatID="AC_{r.channel}" typeLabel="0003" typeDefinition="Objects">\n')
            last = r.channel
        out.write(r.xml + "\n")
        n += 1
    out.write(f'{"</audioChannelFormat>" if last else ""}\n</audioFormatExtended>\n')
    return n


def event_text(events: DataFrame, element: str, position: str, fields: Sequence[str]) -> DataFrame:
    """Delta events (null: unchanged) as lines of text in order of position: line, text ("- ID: 10", then its position and the fields that changed)."""
    lines = F.concat_ws("\n    ", F.concat(F.lit("  - ID: "), F.col(element).cast("string")), F.concat(F.lit("samplePos: "), F.col(position).cast("string")), *(F.concat(F.lit(f"{f}: "), F.col(f).cast("string")) for f in fields))
    return events.orderBy(position, element).select(F.monotonically_increasing_id().alias("line"), lines.alias("text"))


def write_event_set(events: DataFrame, element: str, position: str, fields: Sequence[str], folder: str, name: str, rate: int) -> None:
    """A scene's header and its delta events as text files in a folder: NAME.atmos and the parts of NAME.atmos.metadata, ordered by their names."""
    spark = events.sparkSession
    elements = events.select(element).distinct().orderBy(element)
    header = spark.createDataFrame([(f"version: 0.5.1\npresentations:\n  - type: home\n    metadata: {name}.atmos.metadata\n    audio: {name}.atmos.audio\n    sampleRate: {rate}\n    objects:",)], "text string")
    header.unionByName(elements.select(F.concat(F.lit("      - ID: "), F.col(element).cast("string")).alias("text"))).coalesce(1).write.text(f"{folder}/{name}.atmos")
    event_text(events, element, position, fields).select("text").write.text(f"{folder}/{name}.atmos.metadata")
