"""Equivalence tests, exclusion, multiplicity and verdicts over tables of estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.scalar import Z95, Z975, normal_upper


def tost(df: DataFrame, delta: float, point: str = "point", se: str = "se", tails: bool = False) -> DataFrame:
    """Two one-sided tests of |effect| < delta: lo90, hi90, z_lower, z_upper, equivalent; with tails, p_lower, p_upper, p.

    The verdict compares z with the 95 % quantile. An se of 0 gives infinite z of the sign of the distance.
    """
    x, s = F.col(point), F.col(se)
    over = lambda d: F.when(s > 0, d / s).otherwise(F.when(d > 0, float("inf")).when(d < 0, float("-inf")).otherwise(0.0))
    out = df.withColumns({"lo90": x - Z95 * s, "hi90": x + Z95 * s, "z_lower": over(x + delta), "z_upper": over(delta - x)})
    out = out.withColumn("equivalent", (F.col("z_lower") > Z95) & (F.col("z_upper") > Z95))
    if tails:
        out = out.withColumns({"p_lower": normal_upper("z_lower"), "p_upper": normal_upper("z_upper")})
        out = out.withColumn("p", F.greatest("p_lower", "p_upper"))
    return out


def smallest_delta(df: DataFrame, point: str = "point", se: str = "se") -> DataFrame:
    """The smallest delta that the 90 % interval lies within."""
    x, s = F.col(point), F.col(se)
    return df.withColumn("smallest_delta", F.greatest(F.abs(x - Z95 * s), F.abs(x + Z95 * s)))


def exclusion(df: DataFrame, deltas: tuple[float, ...] = (0.005, 0.01), point: str = "point", se: str = "se", tails: bool = False) -> DataFrame:
    """Whether a lead of delta or more is excluded, one-sided: a row for each delta."""
    grid = F.explode(F.array(*[F.lit(d) for d in deltas]))
    out = df.withColumn("delta", grid).withColumn("z", (F.col("delta") - F.col(point)) / F.col(se))
    out = out.withColumn("excluded", F.col("z") > Z95)
    return out.withColumn("p", normal_upper("z")) if tails else out


def corrected(df: DataFrame, p: str = "p", keys: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted p-values: p_holm, p_bh. tie orders equal p."""
    order = [F.col(p)] + ([F.col(tie)] if tie else [])
    up = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    m = F.count("*").over(Window.partitionBy(*keys))
    ranked = df.withColumns({"_k": F.row_number().over(up), "_m": m})
    holm = F.max((F.col("_m") - F.col("_k") + 1) * F.col(p)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.col(p) * F.col("_m") / F.col("_k")).over(down)
    return ranked.withColumns({"p_holm": F.least(F.lit(1.0), holm), "p_bh": F.least(F.lit(1.0), bh)}).drop("_k", "_m")


def two_sided(df: DataFrame, point: str = "point", se: str = "se") -> DataFrame:
    """z and the two-sided normal p of point / se."""
    out = df.withColumn("z", F.col(point) / F.col(se))
    return out.withColumn("p", 2 * normal_upper(F.abs("z")))


def intervals(df: DataFrame, point: str = "point", se: str = "se") -> DataFrame:
    return df.withColumns({"lo95": F.col(point) - Z975 * F.col(se), "hi95": F.col(point) + Z975 * F.col(se)})


def verdict_change(new: DataFrame, stored: DataFrame, keys: list[str], verdict: str, value: str) -> DataFrame:
    """New results against stored ones: keys, same_verdict, diff; cells that one side lacks have NULLs."""
    a = new.select(*keys, F.col(verdict).alias("new_verdict"), F.col(value).alias("new_value"))
    b = stored.select(*keys, F.col(verdict).alias("old_verdict"), F.col(value).alias("old_value"))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, (F.col("new_verdict") == F.col("old_verdict")).alias("same_verdict"), (F.col("new_value") - F.col("old_value")).alias("diff"))


def anchor_dependence(df: DataFrame) -> DataFrame:
    """For knobs with gain, mde, lo, hi: the ratio of MDE to gain, and whether the gain lies in the interval."""
    gain = F.col("gain")
    return df.withColumns({"mde_ratio": F.when(gain != 0, F.col("mde") / F.abs(gain)), "gain_in_ci": (gain >= F.col("lo")) & (gain <= F.col("hi"))})
