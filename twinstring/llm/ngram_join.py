"""N-gram Jaccard join by grouped prefixes.

Every document is a set of hashed word shingles in one global order: shingles of high counts
last, the others by hash. Two sets of Jaccard similarity t or more share a shingle among their
first ``n - ceil(t n) + 1``. Documents of equal sets are one class; classes of equal prefix and
size are one group; only groups are joined on their prefix shingles. Group pairs that pass the
size and position filters are expanded to their classes, which pass a bitmap filter and are then
verified on the shingle sets of their whole texts.

The result is linked components, so a pair inside one component need not be looked at. Pivot
rounds compare each entry of a bucket (the groups that share a prefix shingle) with one pivot
only and end with the buckets that still hold several components; the last round compares,
exactly, every entry outside a bucket's largest component with all others. A group whose classes
are in several components is outside of all. A bucket of thousands of near copies thus costs a few
comparisons per member, and no link between different texts is lost. Buckets of very frequent
shingles are dealt over several tasks by a salt.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinstring.llm.shared import collect_garbage, components, discard, freed, plain, stash
from twinstring.llm.words import blocks, chain, lists, shingle_sets, signed

#: Shingle counts are kept in so many counters, by hash: 1 byte each on executors. The order that
#: they give is a matter of speed only; any order gives the same result.
COUNTER_BITS = 21
COUNTER_PARTS = 64
#: Shingles that a task holds before it adds them to its counters.
HELD_SHINGLES = 1 << 20
#: Low bits of a bucket's key that hold the salt, and entries that a salted part has, about.
SALT_BITS = 12
PART_ENTRIES = 1 << 16
#: Longs of the shortest bitmap; each longer kind has four times as many, a bit a shingle at least.
LEAST_LONGS, MOST_LONGS = 8, 1 << 13
#: Pairs of a bucket from which the last round compares bitmaps inside the join.
MANY_PAIRS = 256
#: Partners that a pivot is verified with in one group of rows.
PIVOT_ROWS = 256
#: Pairs that may be broadcast to the texts, some 60 bytes each; checked by a count.
PAIRS_BROADCAST = 200_000


def _need(n: np.ndarray | int, num: int, den: int):
    """Least overlap of a set of n shingles with any partner: ceil(t n)."""
    return -(-n * num // den)


class Order:
    """Rank of shingles by count, in steps of a few percent, and parts of hot buckets."""

    def __init__(self, counts: np.ndarray):
        usual = float(np.median(counts))
        self.noise = usual**0.5 + 1
        over = np.maximum(counts - usual, 0) / self.noise
        self.rank = np.minimum(np.floor(8 * np.log2(1 + over)), 255).astype(np.uint8)

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return self.rank[(z >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]

    def parts(self, rank: np.ndarray) -> np.ndarray:
        """Parts that a bucket of a shingle of such a rank is dealt over; 0 for one."""
        count = (2 ** (rank.astype(float) / 8) - 1) * self.noise
        return np.minimum(count // PART_ENTRIES, (1 << SALT_BITS) - 1).astype(np.uint64)


def _order(docs: DataFrame, k: int) -> Order:
    """Counts over all shingles of all texts, summed by counter."""
    size = 1 << COUNTER_BITS
    step = size // COUNTER_PARTS
    schema = "part int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        parts: list[np.ndarray] = []
        held = 0

        def add() -> None:
            at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            np.add(total, np.bincount(at, minlength=size).astype(np.uint32), out=total)
            parts.clear()

        for batch in batches:
            for b in blocks(batch, "text"):
                z = chain(b.hashes(), k)
                # a shingle that reaches into the next row is none
                over = (b.at[1:, None] - np.arange(1, k)).ravel()
                inside = np.ones(len(z), bool)
                inside[over[(over >= 0) & (over < len(z))]] = False
                parts.append((z[inside] >> np.uint64(64 - COUNTER_BITS)).astype(np.int64))
                held += len(parts[-1])
                if held >= HELD_SHINGLES:
                    add()
                    held = 0
        add()
        rows = []
        for i in range(COUNTER_PARTS):
            each = total[i * step : (i + 1) * step]
            top = int(each.max())
            kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
            if top:
                rows.append((i, each.astype(kind).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "counts"]
        )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                width = len(raw) // step
                each = np.frombuffer(raw, f"<u{width}").astype(np.int64)
                sums[i] = sums[i] + each if i in sums else each
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"]
        )

    each = docs.select("text").mapInArrow(freed(count), schema).repartition(COUNTER_PARTS, "part")
    out = np.zeros(size, np.int64)
    for r in each.mapInArrow(freed(total), schema).collect():  # COUNTER_PARTS rows
        out[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(bytes(r["counts"]), np.int64)
    return Order(out)


def _bitmap(z: np.ndarray, most: int = MOST_LONGS) -> np.ndarray:
    """One bit for each range of hashes, flipped by every shingle in it. Two sets' bitmaps differ
    in no more bits than the sets do in shingles."""
    longs = LEAST_LONGS
    while 64 * longs < len(z) and longs < most:
        longs *= 4
    bits = 64 * longs
    at = (z >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _fingerprint(z: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(z.tobytes())
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


_PROFILE = "id long, n int, fp1 long, fp2 long, pf1 long, pf2 long, prefix array<long>, bits array<long>, short array<long>"


def _profile(docs: DataFrame, k: int, num: int, den: int, order: Order) -> DataFrame:
    """One row per document: size, fingerprints of the set and of its prefix, the prefix in
    global order as bucket keys, and two bitmaps, the second of LEAST_LONGS always."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    low = np.uint64((1 << SALT_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            size, sums, prefixes, maps, short = [], [], [], [], []
            row = 0
            for b in blocks(batch, "text"):
                for z in shingle_sets(b, k):
                    size.append(len(z))
                    p = z
                    if len(z):
                        rank = order(z)
                        at = np.argsort(rank, kind="stable")[: len(z) - _need(len(z), num, den) + 1]
                        p = z[at]
                    sums.append((*_fingerprint(z), *_fingerprint(p)))
                    maps.append(_bitmap(z))
                    short.append(_bitmap(z, LEAST_LONGS))
                    if len(z):
                        parts = order.parts(rank[at])
                        p = p & ~low
                        if parts.any():
                            draw = np.uint64(xxhash.xxh64_intdigest(str(ids[row])))
                            p |= np.where(parts > 1, draw % np.maximum(parts, np.uint64(1)) + np.uint64(1), np.uint64(0)) & low
                    prefixes.append(signed(p))
                    row += 1
            s = np.array(sums, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int32()),
                    *[pa.array(np.ascontiguousarray(s[:, j])) for j in range(4)],
                    lists(prefixes, pa.int64()),
                    lists(maps, pa.int64()),
                    lists(short, pa.int64()),
                ],
                ["id", "n", "fp1", "fp2", "pf1", "pf2", "prefix", "bits", "short"],
            )

    return docs.select("id", "text").mapInArrow(freed(run), _PROFILE)


def _salted(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << SALT_BITS) - 1)) != 0


def _whole(h: Column) -> Column:
    """Key of the bucket that a part belongs to."""
    return h.bitwiseAND(F.lit(-(1 << SALT_BITS)))


def _fits(n1: str, n2: str, num: int, den: int) -> Column:
    """Size filter."""
    return (F.col(n1) * den >= F.col(n2) * num) & (F.col(n2) * den >= F.col(n1) * num)


def _short_apart(x: str, y: str) -> Column:
    """Bits in which two bitmaps of LEAST_LONGS differ, as one compiled expression."""
    total = F.lit(0)
    for j in range(LEAST_LONGS):
        total = total + F.bit_count(F.col(x)[j].bitwiseXOR(F.col(y)[j]))
    return total


def _allowed(num: int, den: int) -> Column:
    """Sizes and bitmaps allow the similarity: sets of similarity t differ in at most
    (1 - t) / (1 + t) of n1 + n2 shingles. Bitmaps of different lengths, of sets around a power
    of four, allow all."""
    most = (F.col("n1") + F.col("n2")) * (den - num)
    few = _short_apart("bits1", "bits2")
    each = F.zip_with("bits1", "bits2", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.when(F.size("bits1") == LEAST_LONGS, few).otherwise(F.aggregate(each, F.lit(0), lambda a, b: a + b))
    unlike = F.size("bits1") != F.size("bits2")
    return _fits("n1", "n2", num, den) & F.when(unlike, True).otherwise(apart * (num + den) <= most)


def _candidates(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b), those that sizes and bitmaps allow. Few pairs go to the sets, so that
    only bitmaps of pairs are moved; many meet them in joins."""
    pairs = stash(pairs, "pairs")
    few = pairs.count() <= PAIRS_BROADCAST

    def side(i: int, c: str) -> DataFrame:
        each = sets.select(F.col("id").alias(c), *[F.col(v).alias(f"{v}{i}") for v in ("n", "bits")])
        return each.join(F.broadcast(pairs), c) if few else each

    x, y = side(1, "a"), side(2, "b")
    both = x.join(y, ["a", "b"]) if few else pairs.join(x, "a").join(y, "b")
    found = stash(both.where(_allowed(num, den)).select("a", "b"), "pairs")
    discard(pairs)
    return found


def _verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets have ``den * intersection >= num * union``. The text of a
    goes to the texts of its partners, PIVOT_ROWS of them at a time, so that each text is moved
    about once per pair; a pivot of many pairs is dealt over several groups."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIVOT_ROWS).alias("parts"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    dealt = stash(dealt, "dealt")
    n_pairs = dealt.count()
    wanted = dealt.select(F.col("b").alias("id"), "a", "part", F.col("b").alias("partner")).unionByName(
        dealt.select("a", "part").distinct().select(F.col("a").alias("id"), "a", "part", F.lit(None).cast("long").alias("partner"))
    )
    if n_pairs <= PAIRS_BROADCAST:
        wanted = F.broadcast(wanted)
    rows = docs.join(wanted, "id").select("a", "part", "partner", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("partner").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            one, partner = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            row = 0
            for block in blocks(batch, "text"):
                for z in shingle_sets(block, k):
                    if partner[row] is None:
                        pivot = z
                    else:
                        at = np.minimum(np.searchsorted(pivot, z), len(pivot) - 1)
                        both = int(np.count_nonzero(pivot[at] == z))
                        if den * both >= num * (len(z) + len(pivot) - both):
                            a.append(one[row])
                            b.append(partner[row])
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = stash(rows.mapInArrow(freed(run), "a long, b long"), "links")
    discard(dealt)
    return found


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, comp)`` with the components that ``links`` join. Links are taken between components,
    which earlier rounds made."""
    x = labels.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    y = labels.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    edges = links.join(x, "a").join(y, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(edges).select(F.col("id").alias("comp"), "root")
    out = stash(
        labels.join(roots, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "labels"
    )
    discard(labels)
    return out


def _entries(rows: DataFrame, classes: DataFrame, ratio: float) -> DataFrame:
    """``(h, gid, n, pos, pivot, pn)``: the groups of every bucket of several, each with the
    least group of its band of sizes in its part of the bucket. One shuffle: the window that
    counts a part and the one that finds the pivot share it."""
    heads = classes.where("id = gid").select("id")
    prefix = rows.join(heads, "id", "left_semi").select(F.col("id").alias("gid"), "n", F.posexplode("prefix").alias("pos", "h"))
    band = F.floor(F.log("n") / F.lit(ratio)).cast("int")
    part = Window.partitionBy("h")
    banded = Window.partitionBy("h", "band")
    each = (
        prefix.withColumn("band", band)
        .withColumn("m", F.count(F.lit(1)).over(part))
        .where((F.col("m") > 1) | _salted(F.col("h")))
        .withColumn("pivot", F.min(F.struct("gid", "n")).over(banded))
    )
    return each.select("h", "gid", "n", "pos", "band", F.col("pivot.gid").alias("pivot"), F.col("pivot.n").alias("pn"))


def _open(entries: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(h, gid, n, pos, band, comp, mixed)`` of the buckets that hold several components: that
    of a group's first class, and whether other classes of the group are in others."""
    mixed = (
        classes.join(labels, "id").groupBy(F.col("gid").alias("id"))
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        .select("id", F.lit(True).alias("mixed"))
    )
    labels = labels.join(mixed, "id", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    e = entries.select(_whole(F.col("h")).alias("h"), F.col("gid").alias("id"), "n", "pos", "band").join(labels, "id")
    apart = e.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("mixed").alias("mix"))
    e = e.join(apart.where("lo <> hi OR mix").select("h").hint("merge"), "h")
    return e.select("h", F.col("id").alias("gid"), "n", "pos", "band", "comp", "mixed")


def _first_pairs(entries: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Each group with the pivot of its part of a bucket and band, the pivots of a salted bucket
    with the least of them, and each class of a group with the group's first."""
    near = entries.where("gid <> pivot").where(_fits("n", "pn", num, den)).select(F.col("pivot").alias("a"), F.col("gid").alias("b"))
    tops = entries.where(_salted(F.col("h")) & (F.col("gid") == F.col("pivot"))).select(_whole(F.col("h")).alias("h"), "band", "gid")
    least = tops.groupBy("h", "band").agg(F.min("gid").alias("a"))
    across = tops.join(least, ["h", "band"]).where("gid <> a").select("a", F.col("gid").alias("b"))
    inside = classes.where("id <> gid").select(F.col("gid").alias("a"), F.col("id").alias("b"))
    return near.unionByName(across).unionByName(inside).distinct()


def _pivot_pairs(
    opened: DataFrame, classes: DataFrame, labels: DataFrame, r: int, num: int, den: int
) -> DataFrame:
    """Each group of an open bucket with one that is drawn by hash per bucket and band, and each
    class of a group likewise, where their components differ."""
    draw = F.xxhash64("gid", "h", F.lit(r))
    top = opened.groupBy("h", "band").agg(F.min_by(F.struct("gid", "n", "comp"), draw).alias("top"))
    across = (
        opened.join(top.hint("merge"), ["h", "band"])
        .select("gid", "n", "comp", F.col("top.gid").alias("a"), F.col("top.n").alias("pn"), F.col("top.comp").alias("ca"))
        .where(F.col("comp") != F.col("ca"))
        .where(_fits("n", "pn", num, den))
        .select("a", F.col("gid").alias("b"))
    )
    many = classes.join(labels, "id")
    top = many.groupBy("gid").agg(F.min_by(F.struct("id", "comp"), F.xxhash64("id", F.lit(r))).alias("top"))
    inside = (
        many.join(top, "gid")
        .where("comp <> top.comp")
        .select(F.col("top.id").alias("a"), F.col("id").alias("b"))
    )
    return across.unionByName(inside).distinct()


def _all_pairs(
    opened: DataFrame, classes: DataFrame, several: DataFrame, labels: DataFrame, bits: DataFrame, num: int, den: int
) -> tuple[DataFrame, list[DataFrame]]:
    """All pairs of classes of a bucket's groups, and of a group, in different components. In a
    bucket one side of a pair is outside its largest component: a third of all rows in one
    component costs one comparison per row and such an entry. A group whose classes are in several
    components is outside and meets all groups, its first class's component too. In buckets of
    many pairs the short bitmaps are compared inside the join: those of two groups' first classes,
    as far apart as the groups' classes may be and each group's are among themselves. Those of two
    classes are compared where groups are expanded. Also the tables that the pairs are read from."""
    sizes = opened.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("mixed")).alias("m"))
    main = sizes.groupBy("h").agg(
        F.max_by("comp", F.struct("m", "comp")).alias("main"),
        ((F.sum("total") - F.max("m")) * F.sum("total") > MANY_PAIRS).alias("many"),
    )
    e = opened.join(main.hint("merge"), "h")
    e = stash(e.withColumn("inner", ~F.col("mixed") & (F.col("comp") == F.col("main"))).drop("main"), "buckets")
    short = bits.select("id", "short")
    radius = (
        several.where("id <> gid").join(short, "id")
        .join(short.select(F.col("id").alias("gid"), F.col("short").alias("first")), "gid")
        .groupBy("gid").agg(F.max(_short_apart("short", "first")).alias("radius"))
    )
    heads = short.withColumnRenamed("id", "gid").join(radius, "gid", "left").withColumn("radius", F.coalesce("radius", F.lit(0)))
    ahead = F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"))
    room = (ahead + F.least("pos1", "pos2")) * (num + den) >= (F.col("n1") + F.col("n2")) * num
    apart = F.col("mixed1") | F.col("mixed2") | (F.col("comp1") != F.col("comp2"))
    once = F.col("inner2") | (F.col("gid1") < F.col("gid2"))
    on = apart & once & _fits("n1", "n2", num, den) & room
    most = (F.col("n1") + F.col("n2")) * (den - num)
    near = (_short_apart("short1", "short2") - F.col("radius1") - F.col("radius2")) * (num + den) <= most

    def met(e: DataFrame, on: Column) -> DataFrame:
        x, y = (e.select("h", *[F.col(c).alias(f"{c}{i}") for c in e.columns if c != "h"]) for i in (1, 2))
        both = x.where(~F.col("inner1")).join(y.hint("merge"), "h").where(on)
        return both.select(F.least("gid1", "gid2").alias("gid1"), F.greatest("gid1", "gid2").alias("gid2"))

    few = met(e.where(~F.col("many")), on)
    groups = stash(few.unionByName(met(e.where("many").join(heads, "gid"), on & near)).distinct(), "pairs")
    wanted = several.select("gid").unionByName(groups.select(F.explode(F.array("gid1", "gid2")).alias("gid")))
    every = classes.join(wanted, "gid", "left_semi").join(labels, "id").join(bits.select("id", "n", "short"), "id")
    every = stash(every, "classes")
    x, y = (every.select(*[F.col(c).alias(f"{c}{i}") for c in every.columns]) for i in (1, 2))
    # Components of two groups meet before their classes do, as two groups may have many of one.
    parts = stash(every.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("m")), "parts")
    one, two = (parts.select(F.col("gid").alias(f"gid{i}"), F.col("comp").alias(f"comp{i}")) for i in (1, 2))
    across = groups.join(one, "gid1").join(two, "gid2").where("comp1 <> comp2")
    across = across.join(x, ["gid1", "comp1"]).join(y, ["gid2", "comp2"])
    main = parts.groupBy("gid").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    main = main.where("lo <> hi").select(F.col("gid").alias("gid1"), "main")
    inside = (
        x.join(main, "gid1").where("comp1 <> main")
        .join(y, F.col("gid1") == F.col("gid2"))
        .where((F.col("comp1") != F.col("comp2")) & ((F.col("comp2") == F.col("main")) | (F.col("id1") < F.col("id2"))))
    )
    alike = _short_apart("short1", "short2") * (num + den) <= most
    # The least class of a component, mostly, is the pivot of its pairs.
    ids = F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")
    pairs = across.where(alike).select(*ids).unionByName(inside.where(alike).select(*ids)).distinct()
    return pairs, [e, groups, every, parts]


def jaccard_components(
    docs: DataFrame, k: int = 5, threshold: float | Fraction = 0.8, pivot_rounds: int = 2
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs`` (doc_id, text).

    Words are runs of non-white-space with A-Z in lower case, shingles k words, sets of distinct
    shingles; two documents link at Jaccard similarity ``threshold`` or more and component_id is
    the least doc_id that links lead to. Documents without words (null, empty, white space) have
    no shingle and no link; with fewer than k words the whole sequence is the shingle. Rows that
    repeat a doc_id are documents of their own that share it, with one text or with several. An
    empty table gives an empty result. Extra columns are ignored. Null ids are kept and linked to
    nothing.
    """
    t = Fraction(threshold).limit_denominator(1000)
    num, den = t.numerator, t.denominator
    docs = plain(docs, doc_id="long", text="string")
    known = docs.where("doc_id IS NOT NULL")
    repeated = known.select("doc_id").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        out = _linked(docs.withColumnRenamed("doc_id", "id"), k, num, den, pivot_rounds)
        return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("comp").alias("component_id"))
    rows = stash(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    id_ = F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("id")
    out = _linked(rows.select(id_, "text"), k, num, den, pivot_rounds)
    null = out.where("id IS NULL").select(F.col("id").alias("doc_id"), "n_shingles", F.col("comp").alias("component_id"))
    out = out.where("id IS NOT NULL").join(rows.select(F.col("row").alias("id"), "doc_id"), "id")
    least = out.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = out.join(least, "comp").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(null)


def _linked(docs: DataFrame, k: int, num: int, den: int, pivot_rounds: int) -> DataFrame:
    """``(id, n_shingles, comp)`` of ``docs`` (id, text), whose ids are unique but for nulls."""
    rows = stash(_profile(docs, k, num, den, _order(docs, k)), "shingles")
    key = ["n", "fp1", "fp2"]
    live = rows.where("n > 0 AND id IS NOT NULL")
    classes = live.groupBy(*key).agg(F.min("id").alias("id"), F.first("pf1").alias("pf1"), F.first("pf2").alias("pf2"))
    classes = stash(classes, "sets")
    groups = classes.groupBy("n", "pf1", "pf2").agg(F.min("id").alias("gid"))
    sets, classes = classes, stash(classes.join(groups, ["n", "pf1", "pf2"]).select("id", "gid"), "classes")
    ratio = float(np.log(den / num)) or 1.0
    entries = stash(_entries(rows, classes, ratio), "entries")
    several = stash(classes.where("id <> gid").select("gid").distinct().join(classes, "gid").select("id", "gid"), "groups")

    bits = rows.select("id", "n", "bits")
    labels = stash(classes.select("id", F.col("id").alias("comp")), "labels")
    pairs = _first_pairs(entries, several, num, den)
    read = []
    spark = docs.sparkSession
    collect_garbage(spark)
    for r in range(pivot_rounds + 1):
        if r:
            opened = stash(_open(entries, several, labels), "entries")
            discard(entries)
            entries = opened
        if r == pivot_rounds:
            pairs, read = _all_pairs(entries, classes, several, labels, rows, num, den)
        elif r:
            pairs = _pivot_pairs(entries, several, labels, r, num, den)
        pairs = _candidates(pairs, bits, num, den)
        for each in read:
            discard(each)
        collect_garbage(spark)
        links = _verify(pairs, docs, k, num, den)
        collect_garbage(spark)
        labels = _merge(labels, links)
        discard(pairs)
        discard(links)
        collect_garbage(spark)
    discard(entries)
    found = sets.join(labels, "id").select(*key, "comp")
    out = rows.select("id", *key).join(found, key, "left")
    comp = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("comp", "id"))
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), comp.alias("comp"))
