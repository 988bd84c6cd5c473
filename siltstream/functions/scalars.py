"""Scalar functions: checksums, decibels, timecodes and text, as columns; only checksums need Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def crc_table(polynomial: int, bits: int) -> np.ndarray:
    """The 256 remainders of a byte, most significant bit first."""
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        r = b << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ polynomial if r & top else r << 1) & mask
        out.append(r)
    return np.array(out, np.uint32)


def crc(data: bytes, polynomial: int, bits: int, start: int = 0) -> int:
    """A cyclic remainder, most significant bit first, no final change."""
    table, mask, r = crc_table(polynomial, bits).tolist(), (1 << bits) - 1, start
    for b in data:
        r = (r << 8 ^ table[(r >> (bits - 8)) ^ b]) & mask
    return r


# The generator polynomials of the public standards.
CRC16_ATSC = 0x8005
CRC16_MLP = 0x002D
CRC8_MLP = 0x63


def crc16_after_shift(data: bytes, polynomial: int = CRC16_MLP) -> int:
    """CRC-16 of the convention that adds a byte to the register after the shift, not before: the last two bytes are never divided."""
    if len(data) < 2:
        return int.from_bytes(data, "big")
    return crc(data[:-2], polynomial, 16) ^ int.from_bytes(data[-2:], "big")


def crcs(values: list[bytes | None], polynomial: int, bits: int, start: int = 0) -> list[int | None]:
    """crc() of many values, a byte of all of them at each step."""
    known = [i for i, v in enumerate(values) if v is not None]
    known.sort(key=lambda i: -len(values[i]))
    lengths = np.array([len(values[i]) for i in known], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(known) else np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(values[i] for i in known), np.uint8)
    table, mask = crc_table(polynomial, bits), np.uint32((1 << bits) - 1)
    r = np.full(len(known), start, np.uint32)
    for t in range(int(lengths[0]) if len(known) else 0):
        live = int(np.searchsorted(-lengths, -t, "left"))  # longer than t
        x = r[:live]
        r[:live] = (x << np.uint32(8) ^ table[(x >> np.uint32(bits - 8)) ^ data[first[:live] + t]]) & mask
    out: list[int | None] = [None] * len(values)
    for i, x in zip(known, r.tolist(), strict=True):
        out[i] = x
    return out


def crc_column(data: Column, polynomial: int, bits: int, start: int = 0) -> Column:
    """crc() of binary values, in Arrow batches; null of null."""

    @F.pandas_udf("long")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(crcs([None if v is None else bytes(v) for v in values], polynomial, bits, start), dtype="Int64")

    return of(data)


def parity_column(data: Column) -> Column:
    """XOR of all bytes of binary values; null of null."""

    @F.pandas_udf("int")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else int(np.bitwise_xor.reduce(np.frombuffer(v, np.uint8))) if len(v) else 0 for v in values], dtype="Int32")

    return of(data)


def nibble_parity(byte: Column) -> Column:
    """XOR of a byte's two halves."""
    return F.shiftright(byte, 4).bitwiseXOR(byte.bitwiseAND(15))


def decibels(ratio: Column) -> Column:
    """20 log10 of an amplitude; minus infinity of 0."""
    return F.when(ratio == 0, F.lit(float("-inf"))).otherwise(20 * F.log10(F.abs(ratio)))


def gain(db: Column) -> Column:
    """The amplitude of a gain in dB; 0 of minus infinity."""
    return F.when(db == F.lit(float("-inf")), F.lit(0.0)).otherwise(F.pow(F.lit(10.0), db / 20))


def wrapped_difference(a: Column, b: Column, modulus: int = 65_536) -> Column:
    return F.pmod(a - b, F.lit(modulus))


def timecode_samples(text: Column, rate: int) -> Column:
    """Samples of a timecode hh:mm:ss.fffff, rounded down; null if it is none."""
    part = lambda k: F.regexp_extract(text, r"^(\d{2,}):([0-5]\d):([0-5]\d)(?:\.(\d{1,9}))?$", k)
    whole = part(1).try_cast("long") * 3600 + part(2).try_cast("long") * 60 + part(3).try_cast("long")
    digits = F.rpad(F.coalesce(F.nullif(part(4), F.lit("")), F.lit("0")), 9, "0").try_cast("long")
    return whole * rate + F.floor(digits * rate / 1_000_000_000).cast("long")


def timecode_text(samples: Column, rate: int) -> Column:
    """hh:mm:ss.fffff of a sample position, rounded down."""
    seconds = F.floor(samples / rate).cast("long")
    parts = F.floor((samples - seconds * rate) * 100_000 / rate).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(seconds / 3600).cast("long")
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("long")), F.lit(":"), two(F.pmod(seconds, F.lit(60))), F.lit("."), F.lpad(parts.cast("string"), 5, "0"))


def duration_text(seconds: Column) -> Column:
    """h:mm:ss.mmm of a number of seconds."""
    ms = F.round(seconds * 1000).cast("long")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(F.floor(ms / 3_600_000).cast("string"), F.lit(":"), pad(F.floor(F.pmod(ms, F.lit(3_600_000)) / 60_000), 2), F.lit(":"), pad(F.floor(F.pmod(ms, F.lit(60_000)) / 1000), 2), F.lit("."), pad(F.pmod(ms, F.lit(1000)), 3))


def hex_dump(data: Column) -> Column:
    """Bytes as pairs of hexadecimal digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(F.hex(data)), "(..)", "$1 "))


def peak_bit_rate(rate: Column, sampling: Column) -> Column:
    """(rate * sampling + 8) / 16, rounded down, as it is declared."""
    return F.shiftright(rate * sampling + 8, 4)


def average_bit_rate(size_bytes: Column, seconds: Column) -> Column:
    """Bits a second; null of no duration."""
    return F.try_divide(size_bytes * 8, F.when(seconds > 0, seconds))


def dequantise(q: Column, steps: Column, size: Column) -> Column:
    """A quantised step back to its value, around the middle one."""
    return (q - F.floor(steps / 2)) * size
