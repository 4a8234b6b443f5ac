"""Tables of an audit, and the gates that hold them to their contract.

A missing score is NULL, never NaN: Spark ranks NaN above all numbers, so a NaN would win every maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORES = "row_id bigint, class_id int, model string, score double"
TARGETS = "row_id bigint, class_id int, y int"
META = "row_id bigint, filename string, fold int, author string"
CLASSES = "class_id int, primary_label string, scientific_name string, class_name string"
VOCABULARY_MAP = "primary_label string, class_name string, stage string, idxs string"
WINDOWS = "filename string, start string, end string, primary_label string"
FOLDS = "filename string, fold int"
TRAIN = "filename string, primary_label string, secondary_labels string, author string, latitude double, longitude double"


class GateError(ValueError):
    """A table breaks its contract."""


def missing_as_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes NULL."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def require_rows(df: DataFrame, count: int, what: str) -> DataFrame:
    """df, if it has exactly count rows."""
    if (found := df.count()) != count:
        raise GateError(f"{what}: {found} rows, not {count}")
    return df


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, if no key repeats; a join on a repeated key would multiply rows silently."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise GateError(f"{what}: {', '.join(keys)} repeat")
    return df


def require_present(df: DataFrame, column: str, what: str) -> DataFrame:
    """df, if the column has no NULL."""
    if not df.filter(F.col(column).isNull()).isEmpty():
        raise GateError(f"{what}: {column} is missing in some rows")
    return df


def require_finite(df: DataFrame, column: str, what: str) -> DataFrame:
    """df, if the column has no NaN and no infinity."""
    if not df.filter(F.isnan(column) | (F.abs(column) == float("inf"))).isEmpty():
        raise GateError(f"{what}: {column} is not finite in some rows")
    return df


def require_aligned(a: DataFrame, b: DataFrame, keys: list[str], what: str) -> None:
    """Both frames have the same keys."""
    if not a.select(*keys).exceptAll(b.select(*keys)).isEmpty() or not b.select(*keys).exceptAll(a.select(*keys)).isEmpty():
        raise GateError(f"{what}: rows don't match")
