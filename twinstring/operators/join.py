"""Self-join and two-input join on strings within a Levenshtein threshold.

Both inputs are expanded into hashed deletion variants; two strings within distance d share
one of them, so an equi-join on the hash finds every pair, and Spark's cutoff ``levenshtein``
removes the others inside the join condition. The merge hint matters: size estimates ignore
the expansion, so without it a frame of millions of variants is taken for a broadcast.

Equal strings share every variant, so each distinct string is expanded and joined once, and its
rows join the pairs afterwards. Where a string has more than ``TILE`` rows, its rows are dealt into
tiles of about so many, and pairs of tiles, not of strings, are what tasks share.

Strings with too many variants are cut into d + 1 segments instead, of which a string within
distance d holds one at least, shifted by d places at most (Li, Deng, Wang and Feng 2011): an
equi-join on (length, segment number, content), verified in the same way.
"""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinstring.functions import is_ascii, probe_hashes, segment_hashes, variant_hashes
from twinstring.plans.checks import VARIANT_LIMIT, check_distance, check_strings, long_from, normalise


#: Rows of a string that are paired with others as one array.
TILE = 1024
#: Rows that each of them meets in turn: a short sequence that comes again, which files compress.
CHUNK = 64


#: Characters of strings of one length that are compared by masks at distance 2.
MASKED = 64


def spread(frame: DataFrame) -> DataFrame:
    """A single small file would be expanded by one task."""
    want = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(want, "id")


def variant_frame(frame: DataFrame, max_distance: int) -> DataFrame:
    """``(h, id, str, k)``: a row per distinct variant of each string, by k deletions. Up to two are
    written out as rows from the start, which is compiled code and tens of times faster than arrays."""
    text, n = F.col("str"), F.length("str")
    if max_distance > 2:
        return frame.select(F.inline(variant_hashes(text, max_distance)), "id", "str").select("h", "id", "str", "k")
    if max_distance == 0:
        return frame.select(F.xxhash64("str").alias("h"), "id", "str", F.lit(0).alias("k"))
    # Deleted are i and j, of which i = j is one deletion and i = j = 0 none.
    i, j = F.col("i"), F.col("j")
    cut = frame.select("id", "str", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    second = F.explode(F.sequence(i, F.when(i > 0, n).otherwise(0))) if max_distance == 2 else i
    cut = cut.select("id", "str", "i", second.alias("j"))
    # Of the deletions that leave one variant, those that keep the first occurrences of its characters.
    at = lambda p: F.substring(text, p, F.lit(1))
    after = F.when(j == i + 1, j + 1).otherwise(i + 1)
    cut = cut.where((i == 0) | ((at(j) != at(j + 1)) & (at(i) != at(after))))
    rest = F.substring(text, j + 1, n)
    kept = F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, j - i - 1), rest)
    k = F.when(i == 0, 0).when(i == j, 1).otherwise(2)
    return cut.select(F.xxhash64(F.when(i == 0, text).otherwise(kept)).alias("h"), "id", "str", k.alias("k"))


def verified_pairs(
    left: DataFrame, right: DataFrame, max_distance: int, ordered: bool, least_longer: int = 0
) -> DataFrame:
    """Pairs of two frames (h, id, str), each once. ``ordered`` keeps those with row < col;
    the longer string has ``least_longer`` characters at least."""
    a = left.select("h", F.col("id").alias("row"), F.col("str").alias("a"))
    b = right.select("h", F.col("id").alias("col"), F.col("str").alias("b")).hint("merge")
    # Conditions run in this order: each row meets itself by all its variants, and must not be verified.
    on = a["h"] == b["h"]
    if ordered:
        on = on & (F.col("row") < F.col("col"))
    on = on & (F.abs(F.length("a") - F.length("b")) <= max_distance)
    if least_longer:
        on = on & (F.greatest(F.length("a"), F.length("b")) >= least_longer)
    on = on & (F.levenshtein(F.col("a"), F.col("b"), max_distance) >= 0)
    dist = F.levenshtein(F.col("a"), F.col("b"), max_distance).cast("int").alias("dist")
    return a.join(b, on).select("row", "col", dist).distinct()


def representatives(frame: DataFrame) -> DataFrame:
    """``(id, str, n)``: each distinct string once, with its least id and its number of rows."""
    return frame.groupBy("str").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "str", "n")


def members(frame: DataFrame, reps: DataFrame) -> DataFrame:
    """``(rep, id)`` of all rows whose string occurs more than once: nothing where all differ, so
    that what is joined with it afterwards need not be shuffled."""
    many = reps.where("n > 1").select(F.col("id").alias("rep"), "str")
    return frame.join(many, "str").select("rep", "id")


def expand(pairs: DataFrame, left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Pairs of representatives become pairs of all rows that hold the same strings, of which one
    has ``most`` rows."""
    if most <= 1:
        return pairs
    if most > TILE:
        met = meet(tile_pairs(pairs, tile_counts(left), tile_counts(right)), tiles(left), tiles(right))
        return met.select(F.col("x").alias("row"), F.col("y").alias("col"), "dist")
    x = left.select(F.col("rep").alias("row"), F.col("id").alias("row_id"))
    y = right.select(F.col("rep").alias("col"), F.col("id").alias("col_id"))
    both = pairs.join(x, "row", "left").join(y, "col", "left")
    return both.select(F.coalesce("row_id", "row").alias("row"), F.coalesce("col_id", "col").alias("col"), "dist")


def equal_pairs(same: DataFrame, most: int) -> DataFrame:
    """Pairs of rows with one string, from ``members``."""
    if most > TILE:
        return own_pairs(same).select(F.least("x", "y").alias("row"), F.greatest("x", "y").alias("col"), "dist")
    a = same.select("rep", F.col("id").alias("row"))
    b = same.select("rep", F.col("id").alias("col")).hint("merge")
    return a.join(b, "rep").where("row < col").select("row", "col", F.lit(0).alias("dist"))


def mask_pairs(frame: DataFrame, n: int) -> DataFrame:
    """Pairs row < col within distance 2 of distinct ASCII strings that all have n characters, such
    as numbers. Those that differ in one or two places meet where just these are masked, once and
    without others; what is left loses a character in one place and gets one in another."""
    mask = "\u00bf"
    text, i, j = F.col("str"), F.col("i"), F.col("j")
    two = frame.select("id", "str", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    two = two.select("id", "str", "i", F.explode(F.sequence(i, F.lit(n))).alias("j"))
    parts = [F.substring(text, F.lit(1), i - 1), F.lit(mask), F.substring(text, i + 1, j - i - 1)]
    m = F.concat(*parts, F.when(i < j, mask).otherwise(""), F.substring(text, j + 1, F.lit(n)))
    at = lambda p: F.ascii(F.substring(text, p, F.lit(1)))
    masked = two.select("id", m.alias("m"), at(i).alias("c"), at(j).alias("d"), (i < j).alias("both"))
    masked = masked.withColumn("h", F.xxhash64("m"))
    a = masked.select("h", F.col("id").alias("row"), "m", "c", "d", "both")
    b = masked.toDF("id", "m2", "c2", "d2", "both2", "h2").withColumnRenamed("id", "col").hint("merge")
    on = (F.col("h") == F.col("h2")) & (F.col("row") < F.col("col")) & (F.col("c") != F.col("c2"))
    on = on & (F.col("d") != F.col("d2")) & (F.col("m") == F.col("m2"))
    replaced = a.join(b, on).select("row", "col", F.when(F.col("both"), 2).otherwise(1).alias("dist"))

    once = variant_frame(frame, 1).where("k = 1")
    a = once.select("h", F.col("id").alias("row"), F.col("str").alias("a"))
    b = once.select("h", F.col("id").alias("col"), F.col("str").alias("b")).hint("merge")
    differ = [F.when(F.substring("a", k, 1) != F.substring("b", k, 1), 1).otherwise(0) for k in range(1, n + 1)]
    on = (a["h"] == b["h"]) & (F.col("row") < F.col("col")) & (reduce(lambda x, y: x + y, differ) > 2)
    moved = a.join(b, on & (F.levenshtein(F.col("a"), F.col("b"), 2) == 2)).select("row", "col").distinct()
    return replaced.unionByName(moved.withColumn("dist", F.lit(2)))


def tiles(same: DataFrame) -> DataFrame:
    """``(rep, t, nt, ids)``: the rows of each of ``members``'s strings by hash in nt tiles, each a
    sorted array."""
    dealt = same.join(tile_counts(same), "rep").withColumn("t", F.pmod(F.xxhash64("id"), "nt").cast("int"))
    return dealt.groupBy("rep", "t", "nt").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def tile_counts(same: DataFrame) -> DataFrame:
    return same.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("nt"))


def below(n: Column) -> Column:
    """A row for each of 0 .. n - 1."""
    return F.explode(F.sequence(F.lit(0), n - 1))


def meet(pairs: DataFrame, left: DataFrame, right: DataFrame, single: bool = True) -> DataFrame:
    """Pairs of tiles (row, t1, col, t2, dist) become pairs of their rows, x and y for row and col.
    Tasks are dealt pairs of tiles by the second one, however few strings there are; the number is
    given, as few bytes make many rows. ``single``: strings of one row occur, and have no tile."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.select(F.col("rep").alias("row"), F.col("t").alias("t1"), F.col("ids").alias("xs"))
    b = right.select(F.col("rep").alias("col"), F.col("t").alias("t2"), F.col("ids").alias("ys"))
    how = "left" if single else "inner"
    both = pairs.join(a, ["row", "t1"], how).repartition(parts, "col", "t2")
    both = both.join(b.repartition(parts, "col", "t2").hint("merge"), ["col", "t2"], how)
    xs, ys = F.col("xs"), F.col("ys")
    if single:
        xs, ys = F.coalesce(xs, F.array("row")), F.coalesce(ys, F.array("col"))
    chunks = F.transform(F.sequence(F.lit(1), F.size(ys), F.lit(CHUNK)), lambda at: F.slice(ys, at, CHUNK))
    both = both.withColumn("chunk", F.explode(chunks)).withColumn("x", F.explode(xs))
    return both.withColumn("y", F.explode("chunk"))


def tile_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of representatives become pairs of tiles; ``left`` and ``right`` are ``tile_counts``."""
    x = left.select(F.col("rep").alias("row"), F.col("nt").alias("nx"))
    y = right.select(F.col("rep").alias("col"), F.col("nt").alias("ny"))
    one = F.lit(1)
    both = pairs.join(x, "row", "left").join(y, "col", "left")
    both = both.select("row", "col", "dist", "ny", below(F.coalesce("nx", one)).alias("t1"))
    return both.select("row", "t1", "col", below(F.coalesce("ny", one)).alias("t2"), "dist")


def own_tile_pairs(counts: DataFrame) -> DataFrame:
    """Each two tiles of one string once, a tile with itself too."""
    own = counts.select(F.col("rep").alias("row"), F.col("rep").alias("col"), below(F.col("nt")).alias("t2"))
    return own.select("row", below(F.col("t2") + 1).alias("t1"), "col", "t2", F.lit(0).alias("dist"))


def own_pairs(same: DataFrame) -> DataFrame:
    """(x, y) of each two rows (rep, id) of one group, in no order; ids of any type."""
    own = tiles(same)
    return meet(own_tile_pairs(tile_counts(same)), own, own, single=False).where("t1 <> t2 OR x < y")


def most_rows(reps: DataFrame) -> int:
    """Rows of the most frequent string."""
    return reps.agg(F.max("n")).first()[0] or 0


def rep_pairs(
    left: DataFrame, right: DataFrame, max_distance: int, ordered: bool, long: bool, variant_limit: int
) -> DataFrame:
    """Pairs of distinct strings. Those under the limit meet by variants; where there are ``long``
    ones, they meet each other and strings about as long by segments."""
    x = spread(left)
    y = x if right is left else spread(right)
    if not long:
        return verified_pairs(variant_frame(x, max_distance), variant_frame(y, max_distance), max_distance, ordered)
    m = long_from(max_distance, variant_limit)
    short = [variant_frame(f.where(F.length("str") < m), max_distance) for f in (x, y)]
    near = [f.where(F.length("str") >= m - max_distance) for f in (x, y)]
    probes = near[0].select(F.explode(probe_hashes(F.col("str"), max_distance)).alias("h"), "id", "str")
    segments = near[1].select(F.explode(segment_hashes(F.col("str"), max_distance)).alias("h"), "id", "str")
    return verified_pairs(*short, max_distance, ordered).unionByName(
        verified_pairs(probes, segments, max_distance, ordered, m)
    )


def with_repeats(pairs: DataFrame, same: DataFrame, most: int) -> DataFrame:
    """Pairs row < col of the rows behind pairs of distinct strings of one frame, of which one has
    ``most`` rows."""
    if most <= 1:
        return pairs
    pairs = expand(pairs, same, same, most)
    ordered = pairs.select(F.least("row", "col").alias("row"), F.greatest("row", "col").alias("col"), "dist")
    return ordered.unionByName(equal_pairs(same, most))


def within_variants(variants: DataFrame, same: DataFrame, max_distance: int, most: int) -> DataFrame:
    """Pairs of the rows behind a variant frame of distinct strings and their ``members``."""
    if max_distance == 0:
        return equal_pairs(same, most)
    return with_repeats(verified_pairs(variants, variants, max_distance, ordered=True), same, most)


def within_frames(frame: DataFrame, max_distance: int, long: bool = False, variant_limit: int = VARIANT_LIMIT) -> DataFrame:
    reps = representatives(frame)
    same = members(frame, reps)
    size = F.length("str")
    seen = reps.agg(
        F.max("n"), F.min("str"), F.max("str"), F.min(size), F.max(size), F.bool_and(is_ascii(F.col("str")))
    ).first()
    most, first, last, least, longest, ascii_only = seen
    most = most or 0
    if max_distance == 0:
        return equal_pairs(same, most)
    if long or not most:
        return with_repeats(rep_pairs(reps, reps, max_distance, True, long, variant_limit), same, most)
    # What all strings begin with has no part in distances.
    begin = len(commonprefix([first, last]))
    cores = reps.select("id", F.substring("str", begin + 1, longest).alias("str"))
    n = longest - begin
    if max_distance == 2 and least == longest and ascii_only and 0 < n <= MASKED:
        return with_repeats(mask_pairs(spread(cores), n), same, most)
    return with_repeats(rep_pairs(cores, cores, max_distance, True, long, variant_limit), same, most)


def across_frames(
    query: DataFrame, reference: DataFrame, max_distance: int, long: bool = False, variant_limit: int = VARIANT_LIMIT
) -> DataFrame:
    q, r = representatives(query), representatives(reference)
    pairs = rep_pairs(q, r, max_distance, False, long and max_distance > 0, variant_limit)
    return expand(pairs, members(query, q), members(reference, r), max(most_rows(q), most_rows(r)))


def in_order(pairs: DataFrame, sort: bool) -> DataFrame:
    return pairs.orderBy("row", "col") if sort else pairs


def neighbors_within(
    df: DataFrame,
    id_col: str = "id",
    str_col: str = "str",
    max_distance: int = 1,
    *,
    sort: bool = False,
    validate: bool = True,
    variant_limit: int = VARIANT_LIMIT,
) -> DataFrame:
    """All ``(row LONG, col LONG, dist INT)`` with row < col and Levenshtein distance at most
    ``max_distance``. Ids must be unique. Empty strings are ordinary strings, an empty input
    gives no pairs; nulls and non-ASCII strings raise unless ``validate`` is off, and then
    null strings pair with nothing. Strings with more than ``variant_limit`` deletion variants are
    compared by segments, where inputs are validated."""
    check_distance(max_distance)
    frame = normalise(df, id_col, str_col)
    long = False
    if validate:
        long = check_strings(frame, max_distance, "query", variant_limit)
    else:
        frame = frame.dropna()
    return in_order(within_frames(frame, max_distance, long, variant_limit), sort)


def neighbors_across(
    query_df: DataFrame,
    reference_df: DataFrame,
    id_col: str = "id",
    str_col: str = "str",
    max_distance: int = 1,
    *,
    reference_id_col: str | None = None,
    reference_str_col: str | None = None,
    sort: bool = False,
    validate: bool = True,
    variant_limit: int = VARIANT_LIMIT,
) -> DataFrame:
    """All ``(row, col, dist)`` of a query row and a reference row within ``max_distance``."""
    check_distance(max_distance)
    query = normalise(query_df, id_col, str_col)
    reference = normalise(reference_df, reference_id_col or id_col, reference_str_col or str_col)
    long = False
    if validate:
        long = check_strings(query, max_distance, "query", variant_limit)
        long |= check_strings(reference, max_distance, "reference", variant_limit)
    else:
        query, reference = query.dropna(), reference.dropna()
    return in_order(across_frames(query, reference, max_distance, long, variant_limit), sort)
