"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

Document rates minimise the sum of ``r log r - r``, their relative entropy to taking every
document once, under one constraint per source, that its documents' rates times sizes add up to
its target, and the bound ``r <= most``. By the convex dual the rate of a document is
``min(most, exp(x * size))`` with one multiplier x per source: targets above a source tilt it to
its long documents, targets below to its short ones.

Newton's iterations find the multipliers of all sources at once. Each is one distributed
aggregate of gradient and Hessian over the table of (source, size) and the number of documents,
which says all that the dual needs to know of the corpus, joined with the multipliers so far. A
bracket around each root keeps the steps safe where the bound bends the dual. Sums are of whole
numbers, so that they don't depend on the order of rows and any rerun finds the same rates.

Rates become whole copies by systematic rounding along each source's documents in order of size:
copies of a document are the whole numbers that the running sum of rates crosses. Documents of
one source and size have one rate, so that sum is known per (source, size) and, inside, per
block of documents; a hot source or a hot size is split among tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinstring.llm.shared import plain, stash

#: Rates are multiples of 1 / UNIT, so that their sums are exact.
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS
#: Documents of one source and size in a block of the running sum, on average.
BLOCK_ROWS = 2000
#: Offsets of the rounding that are tried for each source.
OFFSETS = 32
#: A multiplier is found when the source's words are off target by such a share; Newton steps at
#: most (from a quarter of them, every other one halves the bracket, as far as it goes).
TOLERANCE = 1e-7
STEPS = 80
#: (source, size) cells that may be broadcast, some 100 bytes each; checked by a count.
CELLS_BROADCAST = 100_000
#: Equal rows that one task writes out.
EXPAND_ROWS = 10_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space. Counted as the ends of runs, by deleting all
    but the first character of each, which makes no array of words."""
    gone = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]*([^\x20\x09-\x0D])(?:[\x20\x09-\x0D]+|$)", "x")
    return F.length(F.regexp_replace(gone, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``target`` of each source of ``(source, source_size)``: ``share`` of all tokens by weight,
    at most ``most`` times the source, the excess reshared by weight until none is above.

    Sources that the cap binds are those of least ``source_size / weight``, so the level that
    resharing ends at comes from one running sum in that order. The table has a row per
    source; its windows see only these.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    pick = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("k", F.row_number().over(order) - 1).withColumn(
        "weight", pick[F.col("k") % len(weights)].cast("double")
    )
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = F.col("cap") / F.col("weight")
    first = Window.orderBy(ratio, "k").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    s = (
        s.withColumn("capped", F.coalesce(F.sum("cap").over(first), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(first), F.lit(0.0)))
        .withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
    )
    level = (F.col("all_size") * F.lit(float(share)) - F.col("capped")) / (F.col("all_weight") - F.col("used"))
    # The first source in that order that the cap doesn't bind.
    open_ = F.when(level <= ratio, F.struct(ratio.alias("ratio"), "k", level.alias("level")))
    s = s.withColumn("open", open_).withColumn("level", F.min("open").over(every)["level"])
    return s.withColumn(
        "target", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap"))
    ).drop("k", "weight", "cap", "capped", "used", "all_size", "all_weight", "open", "level")


def tilted(x: Column, size: Column, most: float) -> Column:
    """Units of the rate ``min(most, exp(x * size))``."""
    top = F.lit(math.log(most))
    rate = F.when(x * size >= top, F.lit(float(most))).otherwise(F.exp(F.least(x * size, top)))
    return F.round(rate * UNIT).cast("long")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def multipliers(cells: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """``(source, source_size, target, x)``: the dual's solution for ``cells`` (source, size, n)
    and ``sources`` (source, source_size, target, least), least being a source's least size
    above 0. Sources without words have x = 0. Below the lower end of the first bracket a source
    is under any target, at the upper end every document is at the bound."""
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    full = live & (F.col("target") >= F.col("source_size") * (most * (1 - 1e-12)))
    share = F.nullif("target", F.lit(0.0)) / F.nullif("source_size", F.lit(0))
    low = F.least(F.log(share) / F.col("least"), F.lit(0.0))
    high = F.lit(math.log(most)) / F.col("least")
    state = sources.select(
        "source",
        "source_size",
        "target",
        F.when(full, high).otherwise(F.lit(0.0)).alias("x"),
        F.when(live, low).otherwise(F.lit(0.0)).alias("lo"),
        F.when(live, high).otherwise(F.lit(0.0)).alias("hi"),
        (~live | full).alias("done"),
    )
    state = stash(state, "multipliers")
    for step in range(STEPS):
        if state.where(~F.col("done")).isEmpty():
            break
        now = state.where(~F.col("done"))
        each = cells.join(now.select("source", "x"), _same(cells, now)).select(
            cells["source"], "size", "n", "x", tilted(F.col("x"), F.col("size"), most).alias("units")
        )
        words = (F.col("n") * F.col("size")).cast("decimal(20,0)") * F.col("units")
        open_ = F.when(F.col("x") * F.col("size") < math.log(most), words * F.col("size")).otherwise(F.lit(0))
        sums = each.groupBy("source").agg(
            (F.sum(words).cast("double") / UNIT).alias("got"), (F.sum(open_).cast("double") / UNIT).alias("bend")
        )
        gap = F.col("got") - F.col("target")
        newton = F.col("x") - gap / F.nullif("bend", F.lit(0.0))
        lo = F.when(gap < 0, F.col("x")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("x")).otherwise(F.col("hi"))
        safe = (F.col("bend") > 0) & (newton > lo) & (newton < hi) & F.lit(step < STEPS // 4 or step % 2 == 0)
        found = (F.abs(gap) <= F.col("target") * TOLERANCE) | ((hi - lo) <= F.abs(hi + lo) * 1e-15)
        after = state.join(sums, _same(state, sums), "left").select(
            state["source"],
            "source_size",
            "target",
            F.when(F.col("done") | found, F.col("x")).when(safe, newton).otherwise((lo + hi) / 2).alias("x"),
            F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"),
            F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"),
            (F.col("done") | found).alias("done"),
        )
        state = stash(after, "multipliers")
    return state.select("source", "source_size", "target", "x")


def _crossed(before: Column, after: Column) -> Column:
    """Whole numbers that a running sum, in units, crosses."""
    return F.shiftright(after, UNIT_BITS) - F.shiftright(before, UNIT_BITS)


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies, rate)`` of every row of ``docs``
    (doc_id, text, source).

    size counts words of the whole text (null: 0); a null source is a source and comes last in
    order. taken is copies times size; copies is ``floor(rate)`` or one more, so never above
    ``most``, a whole number. A source whose texts are all empty has target 0, and documents
    without words are taken once each. Rows that repeat are rows of their own; those of one id,
    source and size are alike, and which of them gets a decision is open. An empty table gives
    an empty result; extra columns are ignored. A source's taken words differ from its target by
    about its largest document at most.
    """
    return mixed_rows(docs, weights, share, most, seed).drop("source")


def mixed_rows(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """What ``mix_sources`` returns, with each row's source."""
    d = plain(docs, doc_id="long", text="string", source="string")
    sized = stash(d.select("doc_id", word_count(F.col("text")).alias("size"), "source"), "sizes")
    cells = stash(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    totals = cells.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    )
    solved = multipliers(cells, stash(targets(totals, weights, share, most), "targets"), most)

    placed = cells.join(solved, _same(cells, solved)).select(
        cells["source"], "size", "n", "source_size", "target", tilted(F.col("x"), F.col("size"), most).alias("units")
    )
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("units")).over(before), F.lit(0)))
    placed = stash(placed, "cells")
    # The rounding's offset is free; each source takes the one that brings it nearest its target.
    offsets = [j * (UNIT // OFFSETS) for j in range(OFFSETS)]
    end = F.col("start") + F.col("n") * F.col("units")
    tried = placed.groupBy("source").agg(
        F.first("target").alias("target"),
        *[F.sum(_crossed(F.col("start") + o, end + o) * F.col("size")).alias(f"t{j}") for j, o in enumerate(offsets)],
    )
    best = F.array_min(
        F.array(
            *[
                F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("off"), F.lit(o).alias("offset"))
                for j, o in enumerate(offsets)
            ]
        )
    )
    chosen = tried.select(F.col("source").alias("source_"), best["offset"].alias("offset"))
    placed = placed.join(chosen, F.col("source").eqNullSafe(F.col("source_"))).select(
        F.col("source").alias("s"),
        F.col("size").alias("z"),
        F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"),
        "source_size",
        "target",
        "units",
        (F.col("start") + F.col("offset")).alias("start"),
    )
    placed = stash(placed, "cells")

    # Rows of one id, source and size are alike: one row with their number.
    alike = sized.groupBy("source", "size", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    side = F.broadcast(placed) if placed.count() <= CELLS_BROADCAST else placed
    alike = alike.join(side, alike["source"].eqNullSafe(side["s"]) & (alike["size"] == side["z"])).drop("s", "z")
    draw = F.xxhash64("doc_id", F.lit(seed))
    alike = stash(alike.withColumn("block", F.pmod(draw, F.col("blocks")).cast("int")), "alike")
    key = ["source", "size", "block"]
    split = alike.where("blocks > 1").groupBy(*key).agg(F.sum("m").alias("m"))
    ahead = Window.partitionBy("source", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("ahead", F.coalesce(F.sum("m").over(ahead), F.lit(0))).select(
        *[F.col(c).alias(f"{c}_") for c in key], "ahead"
    )
    inside = Window.partitionBy(*key).orderBy(draw, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    run = alike.withColumn("inside", F.coalesce(F.sum("m").over(inside), F.lit(0)))
    run = run.join(
        split, F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")) & (F.col("block") == F.col("block_")), "left"
    )
    at = F.col("start") + (F.col("inside") + F.coalesce("ahead", F.lit(0))) * F.col("units")
    run = run.withColumn("total", _crossed(at, at + F.col("m") * F.col("units")))

    rate = (F.col("units") / UNIT).alias("rate")
    out = run.select("doc_id", "source", "size", "source_size", "target", "m", "total", rate)
    if not alike.where(F.col("m") > EXPAND_ROWS).isEmpty():
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(EXPAND_ROWS).cast("long")))
        out = out.withColumn("from", part).repartition("doc_id", "source", "size", "from")
    else:
        out = out.withColumn("from", F.lit(0).cast("long"))
    to = F.least(F.col("m"), F.col("from") + EXPAND_ROWS) - 1
    nth = F.explode(F.sequence("from", to))
    copies = F.floor(F.col("total") / F.col("m")) + F.when(F.col("nth") < F.col("total") % F.col("m"), 1).otherwise(0)
    out = out.withColumn("nth", nth).withColumn("copies", copies.cast("long"))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate"
    )
