"""Densities, bins and reproducible uniforms as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MAGNITUDE_BIN


def seconds(time: Column) -> Column:
    return F.unix_micros(time) / F.lit(1e6)


def magnitude_bin(mag: Column, width: float = MAGNITUDE_BIN) -> Column:
    """The number of the bin; halves go to the even one."""
    return F.rint(mag / F.lit(width))


def is_complete(mag: Column, mc: Column, width: float = MAGNITUDE_BIN) -> Column:
    return magnitude_bin(mag, width) * F.lit(width) >= mc - F.lit(width / 4)


def log10_or_null(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def normal_density(x: Column, mu, sigma) -> Column:
    mu, sigma = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mu, sigma))
    return F.exp(F.lit(-0.5) * F.pow((x - mu) / sigma, F.lit(2.0))) / (sigma * F.lit(math.sqrt(2 * math.pi)))


def posterior_background(x: Column, m: dict) -> Column:
    """Share of the background component in the density at x; the values of m are numbers or columns."""
    get = lambda k: m[k] if isinstance(m[k], Column) else F.lit(float(m[k]))
    after = get("weight_aftershocks") * normal_density(x, m["mu_aftershocks"], m["sigma_aftershocks"])
    back = get("weight_background") * normal_density(x, m["mu_background"], m["sigma_background"])
    return back / F.greatest(after + back, F.lit(1e-300))


#: Fixed values of the portable generator: a congruence modulo 2**31 with the middle of the square added.
FACTOR, STEP, MODULUS, MIDDLE, ROUNDS = 1103515245, 12345, 2147483648, 15, 4


def portable_integer(ord_: Column, seed, salt: int) -> Column:
    """0 to 2**31 - 1 from the row's place; whole-number arithmetic, so other engines get the same."""
    seed = seed if isinstance(seed, Column) else F.lit(int(seed))
    x = F.pmod(ord_.cast("long") * 7919 + seed.cast("long") * 104729 + F.lit(salt * 15485863).cast("long"), F.lit(MODULUS).cast("long"))
    for _ in range(ROUNDS):
        x = F.pmod(F.shiftright(x * x, MIDDLE) + x * FACTOR + STEP, F.lit(MODULUS).cast("long"))
    return x


#: Rounds of a permutation, and how often a place outside is sent on.
FEISTEL, WALK = 6, 64


def permuted(place: Column, n: Column, seed: Column, salt: int) -> Column:
    """The place, from 1 to n, that a keyed permutation of these numbers gives to a place.

    A Feistel network over a rectangle of a x b numbers, with a the root of n rounded up: each
    round shifts one coordinate by a hash of the other, which can be undone.  Under a
    of the numbers lie beyond n; a place that is sent there is sent on until it is inside, so the
    numbers up to n are permuted among themselves.
    """
    key = F.pmod(seed.cast("long") * 104729 + F.lit(salt * 15485863), F.lit(MODULUS).cast("long"))

    def hashed(x: np.ndarray) -> np.ndarray:
        """Two steps of the generator: 0 to 2**31 - 1 from whole numbers."""
        x = x % MODULUS
        for _ in range(2):
            x = ((x * x >> MIDDLE) + x * FACTOR + STEP) % MODULUS
        return x

    @F.pandas_udf("bigint")
    def walked(places: pd.Series, sizes: pd.Series, keys: pd.Series) -> pd.Series:
        x, n, k = (c.to_numpy(dtype=np.int64) for c in (places - 1, sizes, keys))
        a = np.ceil(np.sqrt(n.astype(np.float64))).astype(np.int64)
        b = np.ceil(n / a).astype(np.int64)
        out, some = x.copy(), np.arange(len(x))  # those that aren't inside yet
        for _ in range(WALK + 1):
            high, low = np.divmod(out[some], b[some])
            for i in range(FEISTEL):
                if i % 2 == 0:
                    high = (high + hashed(low * 7919 + k[some] + i * 1000003)) % a[some]
                else:
                    low = (low + hashed(high * 7919 + k[some] + i * 1000003)) % b[some]
            out[some] = high * b[some] + low
            some = some[out[some] >= n[some]]
            if not len(some):
                return pd.Series(out + 1)
        raise ValueError("a place stayed outside the permutation")

    return walked(place.cast("long"), n.cast("long"), key)


def portable_uniform(ord_: Column, seed, salt: int) -> Column:
    return portable_integer(ord_, seed, salt) / F.lit(float(MODULUS))


def numpy_uniform(ord_: Column, seed: int) -> Column:
    """The ord-th (from 1) number of numpy's default generator: each batch jumps to its places."""
    @F.pandas_udf("double")
    def draw(places: pd.Series) -> pd.Series:
        values = places.to_numpy()
        order = np.argsort(values, kind="stable")
        out = np.empty(len(values))
        cuts = np.flatnonzero(np.diff(values[order]) != 1) + 1
        for run in np.split(order, cuts) if len(values) else []:
            bits = np.random.PCG64(seed)
            bits.advance(int(values[run[0]]) - 1)
            out[run] = np.random.Generator(bits).random(len(run))
        return pd.Series(out)

    return draw(ord_)
