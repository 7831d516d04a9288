"""Exhaustive string-similarity joins under a Levenshtein threshold, as lazy Spark plans."""

from twinstring.errors import (
    CacheDistanceError,
    DistanceCapError,
    NeighborError,
    NonAsciiError,
    NullStringError,
    TooManyStringsError,
    VariantBudgetError,
)
from twinstring.local import CachedRef, get_neighbors_across, get_neighbors_within
from twinstring.operators.index import NeighborIndex
from twinstring.operators.join import neighbors_across, neighbors_within

__version__ = "0.1.0"
__all__ = [
    "CacheDistanceError",
    "CachedRef",
    "DistanceCapError",
    "NeighborError",
    "NeighborIndex",
    "NonAsciiError",
    "NullStringError",
    "TooManyStringsError",
    "VariantBudgetError",
    "get_neighbors_across",
    "get_neighbors_within",
    "neighbors_across",
    "neighbors_within",
]
