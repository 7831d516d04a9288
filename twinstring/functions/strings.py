"""Column expressions the joins are composed of. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_ascii(text: Column) -> Column:
    """True if every character takes one byte."""
    return F.length(text) == F.octet_length(text)


def _shorter_by_one(text: Column) -> Column:
    """All strings with one character less. ``sequence(0, n)`` minus its head, as
    ``sequence(1, 0)`` would count down for the empty string."""
    cuts = F.filter(F.sequence(F.lit(0), F.length(text)), lambda i: i > 0)
    return F.transform(
        cuts,
        lambda i: F.concat(
            F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))
        ),
    )


def deletion_variants(text: Column, max_distance: int) -> Column:
    """Distinct strings reachable by at most ``max_distance`` single-character deletions,
    the string itself included. Each level is made from the distinct strings of the level
    before, so that no variant is produced once per order of its deletions."""
    level = F.array(text)
    every = level
    for _ in range(max_distance):
        level = F.array_distinct(F.flatten(F.transform(level, _shorter_by_one)))
        every = F.concat(every, level)
    return every if max_distance == 0 else F.array_distinct(every)


def variant_hashes(text: Column, max_distance: int) -> Column:
    """64-bit keys ``h`` of the deletion variants, and their numbers ``k`` of deletions; collisions
    only cost a verification."""
    return F.transform(
        deletion_variants(text, max_distance),
        lambda v: F.struct(F.xxhash64(v).alias("h"), (F.length(text) - F.length(v)).alias("k")),
    )


def _segment(length: Column, i: Column, max_distance: int) -> tuple[Column, Column]:
    """Start and size of segment i of ``max_distance + 1`` nearly equal ones, the longer ones last."""
    parts = max_distance + 1
    size = F.floor(length / parts).cast("int")
    short = parts - length % parts
    return i * size + F.greatest(i - short, F.lit(0)), size + F.when(i >= short, 1).otherwise(0)


def segment_hashes(text: Column, max_distance: int) -> Column:
    """Keys of the segments of a string: its length, the segment's number and content."""

    def key(i: Column) -> Column:
        at, size = _segment(F.length(text), i, max_distance)
        return F.xxhash64(F.length(text), i, F.substring(text, at + 1, size))

    return F.transform(F.sequence(F.lit(0), F.lit(max_distance)), key)


def probe_hashes(text: Column, max_distance: int) -> Column:
    """Keys of the segments that strings within ``max_distance`` can have in common with this one.
    Of d + 1 segments one at least has no edit, and it is shifted by d places at most."""
    n = F.length(text)
    numbers = F.sequence(F.lit(0), F.lit(max_distance))
    shifts = F.sequence(F.lit(-max_distance), F.lit(max_distance))

    def keys(length: Column) -> Column:
        def of(i: Column) -> Column:
            at, size = _segment(length, i, max_distance)
            inside = lambda s: (at + s >= 0) & (at + s + size <= n)
            return F.transform(
                F.filter(shifts, inside), lambda s: F.xxhash64(length, i, F.substring(text, at + s + 1, size))
            )

        return F.flatten(F.transform(numbers, of))

    lengths = F.sequence(F.greatest(n - max_distance, F.lit(0)), n + max_distance)
    return F.array_distinct(F.flatten(F.transform(lengths, keys)))


def variant_count(text: Column, max_distance: int) -> Column:
    """Sum of C(n, k) for k = 0 .. min(d, n) as DOUBLE: variants before removing repeats."""
    n = F.length(text).cast("double")
    total = F.lit(1.0)
    term = F.lit(1.0)
    for k in range(1, max_distance + 1):
        term = term * F.greatest(n - (k - 1), F.lit(0.0)) / k
        total = total + term
    return total


def cutoff_distance(left: Column, right: Column, max_distance: int, above: int = 255) -> Column:
    """Levenshtein distance, or ``above`` beyond ``max_distance``."""
    dist = F.levenshtein(left, right, max_distance)
    return F.when(dist < 0, F.lit(above)).otherwise(dist).cast("int")
