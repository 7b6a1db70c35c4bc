"""A portable hash family, the same in Spark and in any SQL engine with 64-bit whole numbers.

y = (a*x + b) mod P and h = (y*y + c) mod P with P = 2^31 - 1; the square breaks up runs of dense ids. Cells are
h mod 2^bits, so those of a smaller modulus are those of a larger one folded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647
STEP = 362437
# Multiplier and offset of each member of the family.
FAMILY = [(1103515245, 12345), (69069, 362437), (1664525, 1013904223), (22695477, 1), (134775813, 7), (214013, 2531011), (16807, 3), (48271, 11)]


def h(x: Column | str, i: int = 0) -> Column:
    a, b = FAMILY[i % len(FAMILY)]
    x = F.col(x) if isinstance(x, str) else x
    y = F.pmod(F.lit(a) * F.pmod(x.cast("bigint"), F.lit(P)) + F.lit(b), F.lit(P))
    return F.pmod(y * y + F.lit(STEP), F.lit(P))


def cell(x: Column | str, m: int, i: int = 0) -> Column:
    return F.pmod(h(x, i), F.lit(m))


def h_sql(x: str, i: int = 0) -> str:
    a, b = FAMILY[i % len(FAMILY)]
    y = f"(({a} * (({x}) % {P}) + {b}) % {P})"
    return f"(({y} * {y} + {STEP}) % {P})"


def cell_sql(x: str, m: int, i: int = 0) -> str:
    return f"({h_sql(x, i)} % {m})"
