"""Primality of a numeric column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# These bases decide primality for every n below 3.4e14 (Jaeschke 1993).
BASES = (2, 3, 5, 7, 11, 13, 17)
LIMIT = 341_550_071_728_321
# With these bases every n below 3.3e24 is decided (Sorenson and Webster 2015).
LARGE_BASES = (*BASES, 19, 23, 29, 31, 37)


def _times(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """a*b mod n below 2**49: the rounded quotient is off by one at most."""
    quotient = (a.astype(np.float64) * b / n).astype(np.int64)
    with np.errstate(over="ignore"):
        rest = a * b - quotient * n
    rest = np.where(rest < 0, rest + n, rest)
    return np.where(rest >= n, rest - n, rest)


def _strong_probable(n: np.ndarray, base: int) -> np.ndarray:
    """Strong probable-prime test of odd n > base, for the whole array at once."""
    odd = n - 1
    twos = np.zeros_like(n)
    while True:
        even = odd % 2 == 0
        if not even.any():
            break
        odd = np.where(even, odd // 2, odd)
        twos += even
    power, factor, exponent = np.ones_like(n), np.full_like(n, base) % n, odd.copy()
    while exponent.any():
        power = np.where(exponent & 1 == 1, _times(power, factor, n), power)
        factor = _times(factor, factor, n)
        exponent >>= 1
    passed = (power == 1) | (power == n - 1)
    for step in range(1, int(twos.max(initial=0))):
        power = _times(power, power, n)
        passed |= (power == n - 1) & (step < twos)
    return passed


def is_large_prime(n: int) -> bool:
    """Exact primality of one number from ``LIMIT`` up to the end of the 64-bit range, in whole numbers of any size."""
    if any(n % base == 0 for base in LARGE_BASES):
        return False
    twos = ((n - 1) & (1 - n)).bit_length() - 1
    for base in LARGE_BASES:
        power = pow(base, (n - 1) >> twos, n)
        if power not in (1, n - 1) and not any((power := power * power % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def prime_flags(values: np.ndarray) -> np.ndarray:
    """Exact primality of an int64 array. Numbers from ``LIMIT`` up don't fit the array arithmetic and go one by one."""
    large = np.flatnonzero(values >= LIMIT)
    if len(large):
        flags = np.zeros(len(values), dtype=bool)
        flags[large] = [is_large_prime(n) for n in values[large].tolist()]
        rest = np.flatnonzero(values < LIMIT)
        flags[rest] = prime_flags(values[rest])
        return flags
    flags = np.isin(values, BASES)
    open_ = (values > BASES[-1])
    for base in BASES:
        open_ &= values % base != 0
    index = np.flatnonzero(open_)
    for base in BASES:
        if not len(index):
            break
        index = index[_strong_probable(values[index], base)]
    flags[index] = True
    return flags


@F.arrow_udf(T.BooleanType())
def is_prime(number: pa.Array) -> pa.Array:
    """Primality of whole numbers by strong probable-prime tests; the cost per row does not grow with √n."""
    values = pc.fill_null(number, 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
    return pa.array(prime_flags(values), mask=pc.is_null(number).to_numpy(zero_copy_only=False))
