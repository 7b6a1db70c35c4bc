"""Bit packing: most significant bit first, Rice codes of sorted values, and fixed-width arrays."""

from __future__ import annotations

from .sizing import rice_parameter


class BitWriter:
    def __init__(self):
        self.value, self.length = 0, 0

    def write(self, value: int, bits: int) -> None:
        self.value = self.value << bits | value & ((1 << bits) - 1)
        self.length += bits

    def unary(self, n: int) -> None:
        self.write((1 << n) - 1 << 1, n + 1)

    def close(self, pad: int = 1) -> bytes:
        rest = -self.length % 8
        return (self.value << rest | (((1 << rest) - 1) if pad else 0)).to_bytes((self.length + rest) // 8, "big")


class BitReader:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, bits: int) -> int:
        self.left -= bits
        if self.left < 0:
            raise EOFError
        return self.value >> self.left & ((1 << bits) - 1)

    def unary(self) -> int:
        n = 0
        while self.read(1):
            n += 1
        return n


def golomb_encode(values: list[int]) -> bytes:
    """Count, parameter, then the Rice-coded differences of the sorted values."""
    out, last = BitWriter(), 0
    ordered = sorted(values)
    k = rice_parameter(len(ordered), ordered[-1] if ordered else 0)
    out.write(len(ordered), 32)
    out.write(k, 8)
    for v in ordered:
        d, last = v - last, v
        out.unary(d >> k)
        out.write(d, k)
    return out.close()


def golomb_decode(data: bytes) -> list[int]:
    reader = BitReader(data)
    n, k, last, out = reader.read(32), reader.read(8), 0, []
    for _ in range(n):
        last += reader.unary() << k | reader.read(k)
        out.append(last)
    return out


def pack(values: list[int]) -> bytes:
    """Fixed width: 32-bit count, 8-bit width, values."""
    bits = max(1, max(values, default=0).bit_length())
    out = BitWriter()
    out.write(len(values), 32)
    out.write(bits, 8)
    for v in values:
        out.write(v, bits)
    return out.close(0)


def unpack(data: bytes) -> list[int]:
    reader = BitReader(data)
    n, bits = reader.read(32), reader.read(8)
    return [reader.read(bits) for _ in range(n)]
