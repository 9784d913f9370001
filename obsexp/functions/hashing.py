"""Seeded hashes. They depend on row values only, so a retried task draws the same numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 2.0**32


def md5_hex(*parts: Column | str) -> Column:
    """md5 of the parts joined with ``|``; portable across engines."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hex_word(hexed: Column, word: Column | int = 0) -> Column:
    """The 32-bit integer in the given 8-digit word (0 to 3) of an md5 text."""
    start = F.lit(1) + F.lit(8) * word
    return F.conv(F.substr(hexed, start.cast("int"), F.lit(8)), 16, 10).cast("long")


def md5_uniform(*parts: Column | str) -> Column:
    return hex_word(md5_hex(*parts)) / F.lit(_RANGE)


def fast_uniform(seed: int, *parts: Column | str) -> Column:
    """Uniform in [0, 1) from xxhash64: cheaper than md5, for runs that need no cross-engine check."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(2.0**53)


def bucket_of(k: int, seed: int, key: Column | str, method: str = "xxhash64") -> Column:
    """Bucket 0..k-1 of a key."""
    if method == "md5":
        return F.pmod(hex_word(md5_hex(key, F.lit(seed))), F.lit(k)).cast("int")
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int")


def poisson1_thresholds(terms: int = 12) -> list[float]:
    """Cumulative probabilities of a Poisson(1) count, 0 up to ``terms - 1``."""
    total, out = 0.0, []
    for j in range(terms):
        total += math.exp(-1.0) / math.factorial(j)
        out.append(total)
    return out


def poisson1_hex(word: Column) -> Column:
    """Poisson(1) count from an 8-digit hexadecimal word, by inversion.

    Digits of equal length compare like the numbers they spell, so no word is converted: a uniform draw word / 2^32 lies
    below t exactly when the word lies below the next whole number from t * 2^32 on.
    """
    limits = [f"{math.ceil(t * _RANGE):08x}" for t in poisson1_thresholds() if math.ceil(t * _RANGE) < _RANGE]
    count = F.when(word < limits[0], 0)
    for j, limit in enumerate(limits[1:], start=1):
        count = count.when(word < limit, j)
    return count.otherwise(len(limits))
