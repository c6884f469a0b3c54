"""Bit and byte functions: hamming arithmetic, common prefixes, variable-length integers, bit order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_syndrome(x: Column) -> Column:
    """Exclusive or of the indexes of set bits."""
    step = lambda acc, i: acc.bitwiseXOR(F.when(F.getbit(x, i) == 1, i).otherwise(F.lit(0)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0), step)


def hamming_base(x: Column) -> Column:
    """The codeword next to x, without its lowest bit: equal for values one bit apart, mostly."""
    one = F.aggregate(F.sequence(F.lit(1), hamming_syndrome(x)), F.lit(1).cast("long"), lambda acc, _: F.shiftleft(acc, 1))
    one = F.when(hamming_syndrome(x) == 0, F.lit(1).cast("long")).otherwise(one)
    return x.bitwiseXOR(one).bitwiseAND(F.lit(-2).cast("long"))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if not n or a[-n:] == b[-n:]:
        return n
    x, y = np.frombuffer(a, np.uint8)[-n:], np.frombuffer(b, np.uint8)[-n:]
    return int(np.argmax((x != y)[::-1]))


def vli_encode(v: int) -> bytes:
    """Groups of 7 bits, lowest first, high bit set on all but the last; each further byte counts from one more."""
    out = bytearray()
    while v >= 128:
        out.append(v & 127 | 128)
        v = (v >> 7) - 1
    out.append(v)
    return bytes(out)


def vli_decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """Value and the position behind it."""
    v = shift = 0
    while True:
        b = data[at]
        at += 1
        v += (b & 127) << shift
        if b < 128:
            return v, at
        shift += 7
        v += 1 << shift


def vli_size(v: Column) -> Column:
    """Bytes that vli_encode takes."""
    out, limit, power = F.lit(1), 128, 128
    steps = []
    for size in range(2, 10):
        steps.append((limit, size))
        power *= 128
        limit += power
    for least, size in steps:
        if least < 1 << 63:
            out = F.when(v >= F.lit(least), F.lit(size)).otherwise(out)
    return out.cast("long")


def bit_length(x: Column) -> Column:
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def bit_reverse(x: Column, width: int) -> Column:
    """x with its lowest width bits in reverse order, as a long (width below 64)."""
    return F.conv(F.reverse(F.lpad(F.bin(x), width, "0")), 2, 10).cast("long")


def leading_zeros(x: Column, width: int = 64) -> Column:
    return F.lit(width) - bit_length(x)


def trailing_zeros(x: Column, width: int = 64) -> Column:
    return F.when(x == 0, F.lit(width)).otherwise(F.length(F.bin(x)) - F.length(F.rtrim(F.translate(F.bin(x), "01", " 1"))))


def pad_to(x: Column, alignment: int) -> Column:
    """x rounded up to a multiple."""
    return (F.floor((x + (alignment - 1)) / F.lit(alignment)) * alignment).cast("long")


class BitWriter:
    """Bits into bytes, the lowest bit of a value first and from the lowest bit of a byte on."""

    def __init__(self) -> None:
        self._value = self._size = 0

    def put(self, value: int, n: int) -> None:
        """The lowest n bits of value."""
        self._value |= (value & ((1 << n) - 1)) << self._size
        self._size += n

    def put_reversed(self, value: int, n: int) -> None:
        self.put(int(format(value & ((1 << n) - 1), f"0{n}b")[::-1], 2) if n else 0, n)

    def put_vli(self, value: int) -> None:
        for b in vli_encode(value):
            self.put(b, 8)

    def fill_byte(self) -> None:
        self._size = (self._size + 7) & ~7

    def bytes(self) -> bytes:
        return self._value.to_bytes((self._size + 7) // 8, "little")


class BitReader:
    """Reads what BitWriter wrote. Behind the end there are fewer bits than asked for: see `left`."""

    def __init__(self, data: bytes):
        self._value, self._end, self.position = int.from_bytes(data, "little"), 8 * len(data), 0

    @property
    def left(self) -> int:
        return self._end - self.position

    def peek(self, n: int) -> int:
        return self._value >> self.position & ((1 << min(n, self.left)) - 1)

    def get(self, n: int) -> int:
        out = self.peek(n)
        self.position += min(n, self.left)
        return out

    def get_reversed(self, n: int) -> int:
        return int(format(self.get(n), f"0{n}b")[::-1], 2) if n else 0

    def get_vli(self) -> int:
        value, shift = 0, 0
        while True:
            if self.left < 8:
                raise ValueError("an integer goes on behind the end")
            b = self.get(8)
            value += (b & 127) << shift
            if b < 128:
                return value
            shift += 7
            value += 1 << shift
