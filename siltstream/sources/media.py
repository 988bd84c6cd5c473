"""Binary streams as rows: framed records with resync and gaps, PCM, and RIFF or CAF chunks; and the sinks that write them.

A frame's place depends on all frames before it, so a file is read in order by one task; files
are read side by side. Readers take blocks from the file, not the file at once.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import CRC16_ATSC, crc
from .bits import BitReader

SYNC = b"\x0b\x77"
# Fixed values of the AC-3 standard: kilobits a second by half the size code, and sampling rates.
KILOBITS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
RATES = (48_000, 44_100, 32_000)
BLOCKS = (1, 2, 3, 6)
#: Channels of each mode, without the low-frequency one.
MODES = (2, 1, 2, 3, 3, 4, 4, 5)


@dataclass
class FrameHeader:
    size: int  # bytes
    extended: bool
    stream_type: int  # 0 independent, 1 dependent, 2 independent of another programme
    substream: int
    rate: int
    blocks: int


def frame_header(data: bytes) -> FrameHeader | None:
    """The header that begins here; null if none does."""
    if len(data) < 6 or data[:2] != SYNC:
        return None
    identification = data[5] >> 3
    if identification <= 10:
        code, size = data[4] >> 6, data[4] & 63
        if code == 3 or size >= 2 * len(KILOBITS):
            return None
        rate, kilobits = RATES[code], KILOBITS[size >> 1]
        words = kilobits * 1000 * 1536 // (rate * 16) + (size & 1 if code == 1 else 0)
        return FrameHeader(2 * words, False, 0, 0, rate >> max(0, identification - 8), 6)
    if identification > 16:
        return None
    kind, number, words = data[2] >> 6, data[2] >> 3 & 7, (data[2] & 7) << 8 | data[3]
    code = data[4] >> 6
    if kind == 3:
        return None
    if code == 3:
        half = data[4] >> 4 & 3
        if half == 3:
            return None
        rate, blocks = RATES[half] // 2, 6
    else:
        rate, blocks = RATES[code], BLOCKS[data[4] >> 4 & 3]
    return FrameHeader(2 * (words + 1), True, kind, number, rate, blocks)


def frames(stream: io.BufferedIOBase, block: int = 1 << 20) -> Iterator[tuple[int, bytes, FrameHeader | None]]:
    """(offset, bytes, header) of each frame; a run of bytes that are no frame comes as one gap, without header.

    A frame counts if another sync word, or the end of the data, follows it; else one byte is skipped. The result
    doesn't depend on the block size.
    """
    buffer, base, at, ended, gap = b"", 0, 0, False, -1
    while True:
        while not ended and len(buffer) - at < 8192:
            more = stream.read(block)
            ended = not more
            base, buffer, at = base + at, buffer[at:] + more, 0
        if at >= len(buffer):
            break
        header = frame_header(buffer[at : at + 8])
        if header:
            after = buffer[at + header.size : at + header.size + 2]
            whole = at + header.size <= len(buffer)
            if whole and (after == SYNC or len(after) < 2 and ended):
                if gap >= 0:
                    yield gap, b"", None
                    gap = -1
                yield base + at, buffer[at : at + header.size], header
                at += header.size
                continue
        if gap < 0:
            gap = base + at
        step = buffer.find(SYNC, at + 1)
        at = step if step >= 0 else len(buffer) if ended else max(at + 1, len(buffer) - 1)
    if gap >= 0:
        yield gap, b"", None


@dataclass
class StreamInformation:
    """The beginning of a frame's stream information."""

    identification: int
    mode: int  # of the channels
    lfe: bool
    level: int  # of dialogue, in dB below full scale
    compression: int | None
    channel_map: int | None  # of a dependent stream
    channels: int


def stream_information(frame: bytes) -> StreamInformation | None:
    """Null where no frame begins; raises EOFError where it is cut off within what is read here."""
    header = frame_header(frame[:8])
    if header is None:
        return None
    r = BitReader(frame[:32], 16)
    if header.extended:
        r.read(2 + 3 + 11)
        rate = r.read(2)
        r.read(2)
        mode, lfe, identification = r.read(3), r.read(1), r.read(5)
        del rate
    else:
        r.read(16 + 2 + 6)
        identification, _, mode = r.read(5), r.read(3), r.read(3)
        if mode & 1 and mode != 1:
            r.read(2)  # level of the centre
        if mode & 4:
            r.read(2)  # of the surrounds
        if mode == 2:
            r.read(2)  # matrix surround
        lfe = r.read(1)
    level = r.read(5)
    compression = r.read(8) if r.read(1) else None
    channel_map = None
    if header.extended:
        if mode == 0:
            r.read(5)
            if r.read(1):
                r.read(8)
        if header.stream_type == 1 and r.read(1):
            channel_map = r.read(16)
    return StreamInformation(identification, mode, bool(lfe), level or 31, compression, channel_map, MODES[mode] + lfe)


def codec_of(head: bytes) -> str | None:
    """What a file's first bytes begin: truehd, eac3, ac3, wave, caf, or null."""
    if head[4:8] in (b"\xf8\x72\x6f\xba", b"\xf8\x72\x6f\xbb"):
        return "truehd" if head[7] == 0xBA else "mlp"
    if head[:2] == SYNC and (header := frame_header(head)):
        return "eac3" if header.extended else "ac3"
    return "wave" if head[:4] in (b"RIFF", b"RF64") and head[8:12] == b"WAVE" else "caf" if head[:4] == b"caff" else None


def is_family(codec: str | None) -> bool:
    """Whether a codec is of the family that frames() reads."""
    return codec in ("ac3", "eac3")


def described(frames_: DataFrame, keys: list[str], content: str) -> DataFrame:
    """keys, codec and the stream information of frames in a binary column; `error` says where one is cut off, and what was read before stays null."""
    names = ["identification", "mode", "lfe", "level", "compression", "channel_map", "channels"]

    def read(batches):
        for batch in batches:
            rows = []
            for data in batch.column(len(keys)):
                data, info, why = data.as_py() or b"", None, None
                try:
                    info = stream_information(data)
                except EOFError as e:
                    why = str(e)
                rows.append((codec_of(data[:16]), *(getattr(info, n) if info else None for n in names), why))
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keys, "codec", *names, "error"])

    schema = ", ".join([*(f"`{k}` {frames_.schema[k].dataType.simpleString()}" for k in keys), "codec string, identification long, mode long, lfe boolean, level long, compression long, channel_map long, channels long, error string"])
    return frames_.select(*keys, F.col(content)).mapInArrow(read, schema)


FRAME_SCHEMA = "path string, unit long, offset long, kind string, bytes binary, extended boolean, stream_type int, substream int, rate int, blocks int, gap_bytes long"


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.options["path"])
        info = files.get_file_info(path)
        found = files.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        suffixes = tuple(self.options.get("suffixes", "").split(",")) if self.options.get("suffixes") else ("",)
        return [InputPartition(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith(suffixes)]

    def read(self, partition):
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.options["path"])
        with files.open_input_stream(partition.value) as stream:
            yield from frame_rows(partition.value, stream)


def frame_rows(path: str, stream) -> Iterator[tuple]:
    unit, last, gap = 0, 0, None
    for offset, data, header in frames(stream):
        if header is None:
            gap = offset
            continue
        if gap is not None:
            yield path, None, gap, "gap", None, None, None, None, None, None, offset - gap
            gap = None
        yield path, unit, offset, "frame", bytes(data), header.extended, header.stream_type, header.substream, header.rate, header.blocks, None
        unit, last = unit + 1, offset + len(data)
    if gap is not None:
        yield path, None, gap, "gap", None, None, None, None, None, None, None
    del last


class FrameSource(DataSource):
    """spark.dataSource.register(FrameSource); spark.read.format("ac3family").option("suffixes", ".ac3,.ec3").load(path)."""

    @classmethod
    def name(cls):
        return "ac3family"

    def schema(self):
        return FRAME_SCHEMA

    def reader(self, schema):
        return FrameReader(dict(self.options))


def frames_of(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """The same rows from a binaryFile table (each file at once in memory)."""

    def scanned(batches):
        schema = pa.schema([("path", pa.string()), ("unit", pa.int64()), ("offset", pa.int64()), ("kind", pa.string()), ("bytes", pa.binary()), ("extended", pa.bool_()), ("stream_type", pa.int32()), ("substream", pa.int32()), ("rate", pa.int32()), ("blocks", pa.int32()), ("gap_bytes", pa.int64())])
        for batch in batches:
            for p, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = list(frame_rows(p.as_py(), io.BytesIO(data.as_py() or b"")))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInArrow(scanned, FRAME_SCHEMA)


# -- PCM

LAYOUTS = {"s16le": ("<i2", 0), "s16be": (">i2", 0), "s32le": ("<i4", 0), "s32be": (">i4", 0), "s24le": ("u1", 1), "s24be": ("u1", -1), "f32le": ("<f4", 0)}


def decode_pcm(data: bytes, layout: str) -> np.ndarray:
    """Samples as 24-bit whole numbers (16 bits times 256, 32 bits over 256 rounded down), or floats; a part of a sample at the end goes."""
    kind, three = LAYOUTS[layout]
    if three:
        b = np.frombuffer(data, np.uint8)[: len(data) // 3 * 3].reshape(-1, 3).astype(np.int32)
        b = b if three > 0 else b[:, ::-1]
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return v - (v >> 23 << 24)
    size = np.dtype(kind).itemsize
    v = np.frombuffer(data, kind, len(data) // size)
    return v.astype(np.float32) if kind.endswith("f4") else v.astype(np.int32) << 8 if size == 2 else v.astype(np.int32) >> 8


def read_pcm(spark: SparkSession, path: str, layout: str, channels: int, header_bytes: int = 0) -> DataFrame:
    """path, position, channel, sample of raw interleaved files; use positional() to compare two."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = "float" if layout.startswith("f") else "int"

    def sampled(batches):
        for batch in batches:
            for p, data in zip(batch.column(0), batch.column(1), strict=True):
                v = decode_pcm(data.as_py()[header_bytes:], layout)
                for a in range(0, len(v), 1 << 18):
                    part = v[a : a + (1 << 18)]
                    at = np.arange(a, a + len(part))
                    yield pa.RecordBatch.from_arrays([pa.array([p.as_py()] * len(part)), pa.array(at // channels), pa.array((at % channels).astype(np.int32)), pa.array(part)], ["path", "position", "channel", "sample"])

    return files.mapInArrow(sampled, f"path string, position long, channel int, sample {kind}")


# -- chunks


def riff_chunks(data: bytes) -> list[tuple[str, int, int]]:
    """(id, offset of the body, size) of a RIFF or RF64 file; sizes of 0xFFFFFFFF come from ds64."""
    if data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        return []
    out, at, large = [], 12, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4].decode("latin-1"), struct.unpack_from("<I", data, at + 4)[0]
        if name == "ds64" and len(data) >= at + 24:
            large = struct.unpack_from("<Q", data, at + 16)[0]
        if size == 0xFFFFFFFF and name == "data":
            size = large or len(data) - at - 8
        out.append((name, at + 8, size))
        at += 8 + size + (size & 1)
    return out


def caf_chunks(data: bytes) -> list[tuple[str, int, int]]:
    """The same of a CAF file; a data chunk of unknown size reaches to the end."""
    if data[:4] != b"caff":
        return []
    out, at = [], 8
    while at + 12 <= len(data):
        name, size = data[at : at + 4].decode("latin-1"), struct.unpack_from(">q", data, at + 4)[0]
        size = len(data) - at - 12 if size < 0 else size
        out.append((name, at + 12, size))
        at += 12 + size
    return out


def chunks_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, number, id, offset, size of every chunk of RIFF, RF64 and CAF files, from a binaryFile table."""

    def scanned(batches):
        for batch in batches:
            for p, data in zip(batch.column(0), batch.column(1), strict=True):
                raw = data.as_py() or b""
                found = riff_chunks(raw) or caf_chunks(raw)
                yield pa.RecordBatch.from_arrays([pa.array([p.as_py()] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array([c[0] for c in found], pa.string()), pa.array([c[1] for c in found], pa.int64()), pa.array([c[2] for c in found], pa.int64())], ["path", "number", "id", "offset", "size"])

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(scanned, "path string, number int, id string, offset long, size long")


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    return chunks_of(spark.read.format("binaryFile").load(path))


def open_stream(spark: SparkSession, path: str, stdin=None) -> DataFrame:
    """path, content, length of a file or folder, or of the driver's standard input, if path is "-": that is read whole by the driver and must fit its memory."""
    if path != "-":
        return spark.read.format("binaryFile").load(path).select("path", "content", "length")
    import sys

    data = (stdin or sys.stdin.buffer).read()
    return spark.createDataFrame([("-", bytearray(data), len(data))], "path string, content binary, length long")


def memory_pcm(samples: DataFrame, channels: int, most: int = 1 << 28) -> np.ndarray:
    """(position, channel, sample) as an array of frames by channels, in the driver; raises, if it would have more than `most` samples. What is missing is silence."""
    last = samples.agg(F.max("position")).first()[0]
    frames_ = 0 if last is None else last + 1
    if frames_ * channels > most:
        raise ValueError(f"{frames_ * channels} samples are more than {most}")
    out = np.zeros((frames_, channels), np.int32)
    found = samples.select("position", "channel", "sample").toArrow()
    out[np.asarray(found["position"]), np.asarray(found["channel"])] = np.asarray(found["sample"])
    return out


# -- sinks


def wave_header(channels: int, rate: int, bits: int, frames_: int | None, mask: int = 0) -> bytes:
    """The header of a WAVE file: RF64 where sizes need 64 bits; sizes of 0xFFFFFFFF where the length isn't known."""
    align = channels * bits // 8
    size = None if frames_ is None else frames_ * align
    extensible = channels > 2 or bits > 16
    tag = 0xFFFE if extensible else 1
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * align, align, bits)
    if extensible:
        fmt += struct.pack("<HHI", 22, bits, mask) + struct.pack("<H", 1) + bytes.fromhex("000000001000800000aa00389b71")
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    total = None if size is None else 4 + len(body) + 8 + size + (size & 1)
    if total is not None and total > 0xFFFFFFFF:
        ds64 = b"ds64" + struct.pack("<IQQQI", 28, total + 36, size, frames_, 0)
        return b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + ds64 + body + b"data" + struct.pack("<I", 0xFFFFFFFF)
    return b"RIFF" + struct.pack("<I", 0xFFFFFFFF if total is None else total) + b"WAVE" + body + b"data" + struct.pack("<I", 0xFFFFFFFF if size is None else size)


def caf_header(channels: int, rate: int, bits: int, size: int | None) -> bytes:
    align = channels * bits // 8
    desc = struct.pack(">d4sIIIII", float(rate), b"lpcm", 2, align, 1, channels, bits)
    return b"caff" + struct.pack(">HH", 1, 0) + b"desc" + struct.pack(">q", len(desc)) + desc + b"data" + struct.pack(">q", -1 if size is None else size + 4) + struct.pack(">I", 0)


def encode_pcm(samples: np.ndarray, bits: int) -> bytes:
    """24-bit samples as little-endian bytes of 16, 24 or 32 bits."""
    if bits == 16:
        return (samples >> 8).astype("<i2").tobytes()
    if bits == 32:
        return (samples.astype(np.int64) << 8).astype("<i4").tobytes()
    v = samples.astype("<i4").view(np.uint8).reshape(-1, 4)
    return v[:, :3].tobytes()


def write_audio(samples: DataFrame, open_output: Callable[[], io.BufferedIOBase], channels: int, rate: int, bits: int = 24, container: str = "wave") -> int:
    """Writes (position, channel, sample) as one interleaved file, in order; returns the frames. What is missing between positions is silence. Tasks turn runs of frames into bytes; the driver puts them end to end, a partition of the sorted table at a time."""
    by = samples.groupBy("position").agg(F.map_from_entries(F.collect_list(F.struct("channel", "sample"))).alias("by"))
    row = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.coalesce(F.col("by")[c], F.lit(0)))

    def encoded(batches):
        for batch in batches:
            at = np.asarray(batch.column(0))
            values = np.asarray(batch.column(1).flatten()).reshape(-1, channels)
            runs = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]])
            blocks = [encode_pcm(np.ascontiguousarray(values[a:b], np.int32).reshape(-1), bits) for a, b in zip(runs[:-1], runs[1:], strict=True) if b > a]
            firsts = [int(at[a]) for a, b in zip(runs[:-1], runs[1:], strict=True) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(blocks, pa.binary())], ["position", "bytes"])

    frame = channels * bits // 8
    last = samples.agg(F.max("position")).first()[0]
    frames_ = 0 if last is None else last + 1
    size = frames_ * frame
    with open_output() as out:
        out.write(wave_header(channels, rate, bits, frames_) if container == "wave" else caf_header(channels, rate, bits, size) if container == "caf" else b"")
        at = 0
        for r in by.orderBy("position").select(F.col("position").cast("long"), row.alias("s")).mapInArrow(encoded, "position long, bytes binary").toLocalIterator():
            out.write(bytes((r.position - at) * frame))
            out.write(r.bytes)
            at = r.position + len(r.bytes) // frame
        if size & 1 and container == "wave":
            out.write(b"\0")
    return frames_


# -- checksums of frames


def checksums_hold(frame: bytes) -> tuple[bool, bool]:
    """Whether a frame's first checksum (over the first five eighths; true for the extended kind, which has none) and its last hold."""
    header = frame_header(frame[:8])
    if header is None or len(frame) != header.size:
        return False, False
    words = header.size // 2
    part = 2 * ((words >> 1) + (words >> 3))
    return header.extended or crc(frame[2:part], CRC16_ATSC, 16) == 0, crc(frame[2:], CRC16_ATSC, 16) == 0


def _solve(columns: list[int], target: int) -> int | None:
    """The set (as bits) of columns whose XOR is the target."""
    basis: dict[int, tuple[int, int]] = {}
    for k, c in enumerate(columns):
        used = 1 << k
        while c:
            top = c.bit_length()
            if top not in basis:
                basis[top] = (c, used)
                break
            c, used = c ^ basis[top][0], used ^ basis[top][1]
    out = 0
    while target:
        if target.bit_length() not in basis:
            return None
        c, used = basis[target.bit_length()]
        target, out = target ^ c, out ^ used
    return out


def repaired(frame: bytes) -> bytes:
    """The frame with its checksums set so that they hold; nothing else changes. A checksum is linear in its own 16 bits, so these are solved for."""
    header = frame_header(frame[:8])
    if header is None or len(frame) != header.size:
        raise ValueError("not one whole frame")
    out, words = bytearray(frame), header.size // 2
    spans = [(header.size - 2, header.size)] if header.extended else [(2, 2 * ((words >> 1) + (words >> 3))), (header.size - 2, header.size)]
    for at, end in spans:
        out[at : at + 2] = b"\0\0"
        rest = crc(bytes(out[2:end]), CRC16_ATSC, 16)
        columns = []
        for k in range(16):
            probe = bytearray(end - 2)
            probe[at - 2 : at] = (1 << k).to_bytes(2, "big")
            columns.append(crc(bytes(probe), CRC16_ATSC, 16))
        word = _solve(columns, rest)
        if word is None:
            raise ValueError("no checksum fits")
        out[at : at + 2] = word.to_bytes(2, "big")
    return bytes(out)


def repaired_frames(frames_: DataFrame, column: str = "bytes") -> DataFrame:
    """frames_ with repaired bytes and `changed`; rows that are no whole frame stay as they are."""

    def repair(batches):
        for batch in batches:
            k = batch.schema.get_field_index(column)
            out, changed = [], []
            for value in batch.column(k):
                data = value.as_py()
                try:
                    new = data if data is None else repaired(data)
                except ValueError:
                    new = data
                out.append(new)
                changed.append(new != data)
            columns = list(batch.columns)
            columns[k] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(changed, pa.bool_())], [*batch.schema.names, "changed"])

    return frames_.mapInArrow(repair, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames_.schema) + ", changed boolean")
