"""Iterables in, numpy out: the same operators for collections that fit on one machine."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from twinstring.operators.index import NeighborIndex
from twinstring.operators.join import neighbors_across, neighbors_within
from twinstring.plans import checks
from twinstring.sources.text import from_iterable

Triple = tuple[np.ndarray, np.ndarray, np.ndarray]


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _numbered(spark: SparkSession, strings: Iterable[str], side: str, limit: int) -> DataFrame:
    """The strings by position. Iterables are held by the driver anyway, so their size is known."""
    if not isinstance(strings, str):
        strings = list(strings)
        checks.check_size(len(strings), side, limit)
    return from_iterable(spark, strings)


def to_numpy(pairs: DataFrame) -> Triple:
    got = pairs.toPandas()
    return (
        got["row"].to_numpy(dtype=np.uint32),
        got["col"].to_numpy(dtype=np.uint32),
        got["dist"].to_numpy(dtype=np.uint8),
    )


def get_neighbors_within(
    query: Iterable[str], max_distance: int = 1, *, spark: SparkSession | None = None
) -> Triple:
    """Rows, columns and distances of all pairs within ``max_distance``, ordered."""
    df = _numbered(_session(spark), query, "query", checks.POSITIONS_WITHIN)
    return to_numpy(neighbors_within(df, max_distance=max_distance, sort=True))


def get_neighbors_across(
    query: Iterable[str],
    reference: Iterable[str],
    max_distance: int = 1,
    *,
    spark: SparkSession | None = None,
) -> Triple:
    spark = _session(spark)
    q = _numbered(spark, query, "query", checks.POSITIONS_ACROSS)
    r = _numbered(spark, reference, "reference", checks.POSITIONS_ACROSS)
    return to_numpy(neighbors_across(q, r, max_distance=max_distance, sort=True))


class CachedRef:
    """A reference that is expanded once; see :class:`NeighborIndex` for DataFrames."""

    def __init__(
        self, reference: Iterable[str], max_distance: int = 1, *, spark: SparkSession | None = None
    ):
        self._spark = _session(spark)
        self._index = NeighborIndex(
            _numbered(self._spark, reference, "reference", checks.POSITIONS_WITHIN), max_distance=max_distance
        )

    @property
    def max_distance(self) -> int:
        return self._index.max_distance

    def get_neighbors_within(self, max_distance: int = 1) -> Triple:
        return to_numpy(self._index.within(max_distance, sort=True))

    def get_neighbors_across(
        self, query: Iterable[str] | CachedRef, max_distance: int = 1
    ) -> Triple:
        if isinstance(query, CachedRef):
            found = self._index.across(query._index, max_distance=max_distance, sort=True)
        elif isinstance(query, Iterable):
            frame = _numbered(self._spark, query, "query", checks.POSITIONS_WITHIN)
            found = self._index.across(frame, max_distance=max_distance, sort=True)
        else:
            raise ValueError(
                f"query must be either an iterable of str or CachedRef, got '{type(query)}'"
            )
        return to_numpy(found)
