"""Checks made before a plan is built: one aggregate per input."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinstring.errors import (
    CacheDistanceError,
    DistanceCapError,
    NonAsciiError,
    NullStringError,
    TooManyStringsError,
    VariantBudgetError,
)
from twinstring.functions import is_ascii, variant_count

#: Deletion variants that a single string may have. Long texts at d >= 2 pass it; joins compare them by
#: segments, indexes refuse them.
VARIANT_LIMIT = 1_000_000
#: Strings that results with 32-bit positions can number, of one input and of either
#: of two. DataFrames have LONG ids and no limit.
POSITIONS_WITHIN = (1 << 32) - 1
POSITIONS_ACROSS = (1 << 31) - 1


def check_size(n: int, side: str, limit: int) -> None:
    if n > limit:
        raise TooManyStringsError(side, limit, n)


def check_distance(max_distance: int, built_for: int | None = None) -> int:
    if isinstance(max_distance, bool) or not isinstance(max_distance, int):
        raise TypeError(f"max_distance must be an int, got {type(max_distance).__name__}")
    if max_distance < 0:
        raise OverflowError("max_distance can't be negative")
    if max_distance > 254:
        raise DistanceCapError(max_distance)
    if built_for is not None and max_distance > built_for:
        raise CacheDistanceError(built_for, max_distance)
    return max_distance


def normalise(df: DataFrame, id_col: str, str_col: str) -> DataFrame:
    """``(id LONG, str STRING)``; other columns, whatever their names, are left behind."""
    return df.select(df[id_col].cast("long").alias("id"), df[str_col].cast("string").alias("str"))


def check_strings(
    frame: DataFrame, max_distance: int, side: str, variant_limit: int = VARIANT_LIMIT, refuse: bool = False
) -> bool:
    """Raises on nulls and on non-ASCII strings (naming the one with the least id). True if a
    string has too many variants, which raises too under ``refuse``."""
    bad = F.when(~is_ascii(F.col("str")), F.struct("id", "str"))
    row = frame.agg(
        F.count_if(F.col("id").isNull() | F.col("str").isNull()).alias("nulls"),
        F.min(bad).alias("bad"),
        F.max(variant_count(F.col("str"), max_distance)).alias("widest"),
    ).first()
    if row["nulls"]:
        raise NullStringError(row["nulls"], side)
    if row["bad"] is not None:
        raise NonAsciiError(row["bad"]["id"], row["bad"]["str"], side)
    long = (row["widest"] or 0) > variant_limit
    if long and refuse:
        raise VariantBudgetError(side, variant_limit, row["widest"])
    return long


def long_from(max_distance: int, variant_limit: int) -> int:
    """Least length of a string with more deletion variants than ``variant_limit``."""
    few, many = 0, 1
    wide = lambda n: sum(comb(n, k) for k in range(max_distance + 1)) > variant_limit
    while not wide(many):
        few, many = many, 2 * many
    while many - few > 1:
        mid = (few + many) // 2
        few, many = (few, mid) if wide(mid) else (mid, many)
    return many
