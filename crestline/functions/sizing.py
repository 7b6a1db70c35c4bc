"""Sizes and error rates of sketches: the cost model that decides whether and how large a filter is worth sending."""

from __future__ import annotations

import math
from dataclasses import dataclass


def power_of_two(x: float) -> int:
    """The power of two nearest on a log scale, halves up."""
    return 1 << max(0, math.floor(math.log2(max(1.0, x)) + 0.5))


def bloom_eps(record_bits: float, items: int, held: int, transfers: int = 1) -> float:
    """False-positive rate that balances the bits of a filter sent `transfers` times against records sent in vain."""
    ratio = items // held - 1 if held else 0
    return math.inf if ratio <= 0 else transfers * 1.44 / (record_bits * math.log(2) * ratio)


def bloom_size(n: int, eps: float) -> tuple[int, int]:
    """Bits and hashes for n members at a false-positive rate."""
    m = math.ceil(1.44 * math.log2(1 / eps)) * n
    return m, max(1, math.ceil(m / n * math.log(2)))


def gcs_modulus(n: int, eps: float) -> int:
    """0: not worth sending, everything passes."""
    return 0 if eps >= 1 else int(n / eps)


def gcs_eps(n: int, record_bits: float, nodes: int, items: int, length: int, adjuster: float = 1.0, transfers: int = 2) -> float:
    """False-positive rate of a Golomb-coded set of n of a node's `length` rows, among `items` of all nodes.

    0.8 is the share of a Bloom filter's bits that such a set takes; infinite where a filter cannot pay.
    """
    ratio = items // n - 1 if n else 0
    if ratio <= 0 or adjuster <= 0:
        return math.inf
    holders = nodes * length / items
    return transfers * nodes * 0.8 * 1.44 / (record_bits * holders * adjuster * math.log(2) * ratio)


@dataclass(frozen=True)
class Estimate:
    """What a node assumes when it sizes a filter: how far lists differ, a factor on the bits, and whether lower scores count for less.

    overlap: 1 takes all lists as disjoint, 0 as the same items, below 0 the true number of items is used.
    """

    overlap: float = 1.0
    bits: float = 1.0
    weighted: bool = True

    def items(self, length: int, nodes: int, true: int) -> int:
        return true if self.overlap < 0 else length + int(self.overlap * length * (nodes - 1))

    def modulus(self, n: int, best: int, at_k: int, nodes: int, length: int, true: int, record_bits: int = 800) -> int:
        """The power of two of a filter for n rows of scores up to `best`; 0 where sending one costs more than it saves."""
        weight = best / at_k if self.weighted and best < at_k else 1.0
        m = gcs_modulus(n, gcs_eps(n, record_bits, nodes, self.items(length, nodes, true), length, weight))
        return 1 << int((power_of_two(m).bit_length() - 1) * self.bits) if m else 0


def count_min_eps(sent: int, held: int, items: int, record_bits: int = 800) -> float:
    """Error rate of a count-min sketch of `sent` items of which `held` pass, among `items`."""
    return 2 * 1.44 * 0.7 / math.log(2) * sent * sent / (items * record_bits * held)


def count_min_columns(n: int, eps: float) -> int:
    """Columns as a power of two for n items in one row of cells."""
    return power_of_two(math.ceil(n / eps))


def count_min_size(n: int, eps: float, delta: float) -> tuple[int, int]:
    """Rows and columns."""
    return max(1, math.ceil(math.log(1 / delta))), max(1, math.ceil(math.e / eps))


def rice_parameter(n: int, total: int) -> int:
    """The smallest k with (128 n) << k > 128 total + 49 n."""
    k = 0
    while n and (n * 128) << k <= 128 * total + 49 * n:
        k += 1
    return k


def golomb_bits(values: list[int]) -> int:
    """Bits of sorted values as Rice-coded differences."""
    last, deltas = 0, []
    for v in sorted(values):
        deltas.append(v - last)
        last = v
    k = rice_parameter(len(deltas), sum(deltas))
    return sum((d >> k) + 1 + k for d in deltas)


def gcs_bytes(values: list[int]) -> int:
    return 9 + 4 + math.ceil(golomb_bits(values) / 8)


def bloom_bytes(m: int) -> int:
    return 12 + math.ceil(m / 8)


def count_array_bytes(cells: int, largest: int) -> int:
    return 5 + math.ceil(cells * max(1, int(largest).bit_length()) / 8)


def gcs_bytes_model(n: int, m: int) -> int:
    """Bytes of a Golomb-coded set by its size alone: about log2(m / n) + 1.5 bits a member, and its header."""
    return 13 + math.ceil(n * (math.log2(max(1.0, m / n)) + 1.5) / 8) if n else 13
