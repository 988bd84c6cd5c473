"""Reading and writing bits, most significant first."""

from __future__ import annotations


class BitReader:
    """Bits of some bytes; reading beyond them raises EOFError."""

    def __init__(self, data: bytes, at: int = 0):
        self.value, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), at

    def read(self, n: int) -> int:
        if n > self.size - self.at:
            raise EOFError(f"{n} bits wanted, {self.size - self.at} left")
        self.at += n
        return self.value >> (self.size - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        """A number in two's complement."""
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def variable(self, n: int) -> int:
        """Groups of n bits, each followed by a bit that says whether another comes; a group counts on from what fewer groups can say."""
        v = self.read(n)
        while self.read(1):
            v = (v + 1 << n) + self.read(n)
        return v

    def bytes(self, n: int) -> bytes:
        return self.read(8 * n).to_bytes(n, "big")


class BitWriter:
    def __init__(self):
        self.bits, self.n = 0, 0

    def write(self, value: int, n: int) -> "BitWriter":
        if not 0 <= value < 1 << n:
            raise ValueError(f"{value} doesn't fit {n} bits")
        self.bits, self.n = self.bits << n | value, self.n + n
        return self

    def variable(self, value: int, n: int) -> "BitWriter":
        """The inverse of BitReader.variable."""
        groups = [value & (1 << n) - 1]
        while value >> n:
            value = (value >> n) - 1
            groups.append(value & (1 << n) - 1)
        for k, g in enumerate(reversed(groups)):
            self.write(g, n).write(k < len(groups) - 1, 1)
        return self

    def bytes(self) -> bytes:
        """What was written, filled with zeros to a whole byte."""
        fill = -self.n % 8
        return (self.bits << fill).to_bytes((self.n + fill) // 8, "big")
