"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def weighted_mean(total: Column, weight: Column) -> Column:
    """sum(total) / max(1, sum(weight)): partial sums meet before the division."""
    return F.sum(total) / F.greatest(F.lit(1), F.sum(weight))


def lcg(x: Column, steps: int = 1) -> Column:
    """Steps of the 31-bit linear congruential generator x -> 1103515245 x + 12345 (mod 2^31), on bigints."""
    for _ in range(steps):
        x = ((F.lit(1103515245) * x) + F.lit(12345)).bitwiseAND(2147483647)
    return x


def to_int(x: Column, bits: int = 64) -> Column:
    """Bool or integer to an integer; anything out of range raises."""
    kind, edge = ("bigint", 1 << 63) if bits == 64 else ("int", 1 << 31)
    wide = x.cast("decimal(38,0)")
    bound = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    ok = (wide >= bound(-edge)) & (wide < bound(edge))
    return F.when(ok | wide.isNull(), x.cast(kind)).otherwise(F.raise_error(F.lit(f"a value doesn't fit {kind}")).cast(kind))


def _permuted(n: Column, key: int) -> Column:
    """A bijection of the numbers from 0 to 2^32 - 1, on bigints; key: any integer. Products stay under 2^63."""
    n = (n + F.lit(key & 0xFFFFFFFF)).bitwiseAND(0xFFFFFFFF)
    for odd in (0x7FEB352D, 0x2C9277B5):
        n = n.bitwiseXOR(F.shiftright(n, 16))
        n = (n * F.lit(odd)).bitwiseAND(0xFFFFFFFF)
    return n.bitwiseXOR(F.shiftright(n, 15))


def short_id(prefix: str, number: Column | None = None, key: int = 0) -> Column:
    """prefix and 8 hexadecimal digits. Without a number they are random, a new id each time: of 77,000 such ids two are equal
    with a probability of a half. With the number of each row (from 0, see position.counted) and one key for all, no two are
    equal; a number that 8 digits can't hold raises."""
    if number is None:
        return F.concat(F.lit(prefix), F.substring(F.expr("uuid()"), 1, 8))
    n = number.cast("long")
    digits = F.lower(F.lpad(F.hex(_permuted(n, key)), 8, "0"))
    fits = n.isNull() | n.between(0, 0xFFFFFFFF)
    return F.when(fits, F.concat(F.lit(prefix), digits)).otherwise(F.raise_error(F.lit("8 hexadecimal digits can't tell more than 2^32 rows apart")).cast("string"))
