"""Random draws that any engine can repeat: cluster draws of a bootstrap, and permutations by a bijection.

Both are made where they are used. A bootstrap's weights follow from its seed, so executors make them, by a table function
or inside a kernel, and none pass through the driver. A permutation of n places is a Feistel network over a rectangle of
just over n cells: a place's image is arithmetic, without a sort, and images outside are walked on until they fall inside.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

#: A prime; all steps of the network stay below it, so that their products fit in 64 bits.
PRIME = 2147483647
ROUNDS = 6


def drawn(seed: int, rep: int, n: int) -> np.ndarray:
    """How often each of n places is drawn in n draws. Draw k is a quarter of md5(seed:rep:k div 4), modulo n."""
    digests = b"".join(md5(f"{seed}:{rep}:{k}".encode()).digest() for k in range(-(-n // 4)))
    return np.bincount(np.frombuffer(digests, ">u4")[:n].astype(np.int64) % max(n, 1), minlength=n)


@udtf(returnType="_i bigint, w bigint")
class DrawnPlaces:
    """Table function of seed, rep and n: the places that are drawn, and how often."""

    def eval(self, seed: int, rep: int, n: int):
        counts = drawn(seed, rep, n)
        for i in np.flatnonzero(counts).tolist():
            yield i, int(counts[i])


@lru_cache(maxsize=1)
def matrix(seed: int, n: int, first: int, last: int) -> np.ndarray:
    """places x replicates first to last - 1; a Python worker keeps the last one it has made."""
    out = np.empty((n, last - first), np.uint16)
    for rep in range(first, last):
        counts = drawn(seed, rep, n)
        if len(counts) and counts.max() > 65535:
            raise OverflowError("a place is drawn more than 65535 times")
        out[:, rep - first] = counts
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    return (x * x % PRIME * 48271 + x) % PRIME


def image(place: np.ndarray, size: np.ndarray, rep: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each place of `size` places goes in a replicate; h tells clusters apart. A bijection for each (size, rep, h)."""
    high = np.ceil(np.sqrt(size.astype(np.float64))).astype(np.int64)
    wide = -(-size // np.maximum(high, 1))
    out, todo = place.astype(np.int64).copy(), np.arange(len(place))
    while len(todo):
        a, b = high[todo], wide[todo]
        left, right = out[todo] // b, out[todo] % b
        for k in range(ROUNDS):
            key = mixed((h[todo] + rep[todo] * 69621 + k * 16807) % PRIME)
            if k % 2 == 0:
                left = (left + mixed(mixed((right + key) % PRIME))) % a
            else:
                right = (right + mixed(mixed((left + key) % PRIME))) % b
        out[todo] = left * b + right
        todo = todo[out[todo] >= size[todo]]
    return out


def images(place: np.ndarray, size: np.ndarray, h: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """image() of each place in each replicate: places x replicates."""
    if len(place) and (size == size[0]).all() and (h == h[0]).all():
        size, h = size[:1], h[:1]  # one cluster: its keys are made once
    size, h = size.astype(np.int64)[:, None], h.astype(np.int64)[:, None]
    a = np.ceil(np.sqrt(size.astype(np.float64))).astype(np.int64)
    b = -(-size // np.maximum(a, 1))
    left, right = np.divmod(place.astype(np.int64)[:, None], b)
    for k in range(ROUNDS):
        key = mixed((h + reps * 69621 + k * 16807) % PRIME)
        if k % 2 == 0:
            left = left + twice(right + key)
            left -= left // a * a
        else:
            right = right + twice(left + key)
            right -= right // b * b
    out = left * b + right
    i, r = np.nonzero(out >= size)
    if len(i):  # they are walked on
        own = np.zeros_like(i) if len(size) == 1 else i
        out[i, r] = image(out[i, r], size[own, 0], reps[r], h[own, 0])
    return out


def below(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for numbers under twice PRIME."""
    return np.minimum(x.view(np.uint64), (x - PRIME).view(np.uint64)).view(np.int64)  # what would be negative wraps to the top


def twice(x: np.ndarray) -> np.ndarray:
    """mixed(mixed(x modulo PRIME)) for numbers under twice PRIME, 2**31 - 1: a modulus by it adds the high bits to the low ones."""
    x = below(x)
    for _ in range(2):
        y = x * x
        y = ((y & PRIME) + (y >> 31)) * 48271 + x
        x = below((y & PRIME) + (y >> 31))
    return x


def image_of(place: Column, size: Column, rep: Column, h: Column) -> Column:
    """image() as an Arrow UDF."""

    def run(place: pd.Series, size: pd.Series, rep: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(image(*(c.to_numpy(np.int64) for c in (place, size, rep, h))))

    return pandas_udf(run, "bigint")(place, size, rep, h)


def blocks(reps: int, n: int, size: int = 64 << 20) -> list[tuple[int, int]]:
    """Ranges of replicates whose matrices take so many bytes at the most."""
    step = max(1, min(reps, size // max(2 * n, 1)))
    return [(a, min(a + step, reps)) for a in range(0, reps, step)] if reps else []


