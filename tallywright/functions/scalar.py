"""Scalar functions of scores, labels and statistics, as Column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: 95 % of the standard normal lies below; one-sided tests and 90 % intervals use it.
Z95 = 1.6448536269514722
Z975 = 1.959963984540054


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def noisy_or(parts: Column) -> Column:
    """1 - prod(1 - p); NULL for an empty array."""
    value = F.aggregate(parts, F.lit(1.0), lambda a, p: a * (1 - p), lambda a: 1 - a)
    return F.when(F.size(parts) > 0, value)


def gather(values: Column, idxs: Column, how: str = "max") -> Column:
    """The maximum or noisy-OR of values at idxs; NULL if there are none."""
    picked = F.transform(idxs, lambda i: F.get(values, i))
    return F.array_max(picked) if how == "max" else noisy_or(picked)


def genus(name: Column) -> Column:
    """The first word, in lower case."""
    return F.lower(F.element_at(F.split(F.trim(name), r"\s+"), 1))


def seconds(clock: Column) -> Column:
    """HH:MM:SS as seconds."""
    parts = F.split(clock, ":")
    return sum((F.get(parts, k).cast("int") * n for k, n in ((0, 3600), (1, 60), (2, 1))), F.lit(0))


def list_literal(text: Column) -> Column:
    """The strings of a list literal such as ['a', "b"]; an empty array for anything else."""
    found = F.regexp_extract_all(text, F.lit(r"""(?:'([^']*)'|"([^"]*)")"""), F.lit(0))
    stripped = F.transform(found, lambda s: F.substring(s, 2, F.length(s) - 2))
    none = F.array().cast("array<string>")
    return F.when(F.trim(text).startswith("["), stripped).otherwise(none)


def label_list(text: Column, mark: str = ";") -> Column:
    """Trimmed, non-empty parts of a separated list."""
    return F.filter(F.transform(F.split(text, mark), lambda s: F.trim(s)), lambda s: s != "")


def index_list(text: Column) -> Column:
    """Indices of a pipe-joined list; an empty array for an empty text."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda s: F.trim(s) != ""), lambda s: F.trim(s).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    step = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(a, b, step), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normal_upper(z: Column | str) -> Column:
    """P(Z > z), by erfc, so that small tails keep their digits. Spark has no erf, so this is an Arrow UDF."""

    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: None if x is None or x != x else 0.5 * math.erfc(x / math.sqrt(2)))

    return pandas_udf(tail, "double")(z)


def normal_ppf(p: Column | str) -> Column:
    """The z below which a share p of the standard normal lies."""

    def quantile(p: pd.Series) -> pd.Series:
        return p.map(lambda x: NormalDist().inv_cdf(x) if x is not None and 0 < x < 1 else None)

    return pandas_udf(quantile, "double")(p)


def half(x: Column | str) -> Column:
    """The value as 16-bit float and back."""

    def narrow(x: pd.Series) -> pd.Series:
        return x.astype("float16").astype("float64")

    return pandas_udf(narrow, "double")(x)


def hash_draw(*parts) -> Column:
    """A uniform 32-bit number of the parts, the same in any engine that has md5."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
