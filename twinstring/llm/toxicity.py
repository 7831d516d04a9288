"""Toxic passages as maximum-scoring segments of token log-odds.

Units are words and their prefixes of 4 to 8 bytes. A unit's score is its log-odds between
toxic and other documents under a Dirichlet prior in proportion to its overall frequency, less
SURE standard errors: what the evidence guarantees, nothing for units that prove nothing. A
token takes the highest score of its units, or the drift, a small loss that keeps segments
short. One linear scan (Ruzzo and Tompa) finds all maximal segments of a text. Under Karlin and
Altschul's extreme-value law the best segment of n neutral tokens scores above s with
probability about ``K n exp(-lambda s)``; each segment counts by how far it is beyond that, the
sum over a document's segments is its statistic, and a logistic curve turns it into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinstring.llm.shared import crc_mod, freed, plain, stash
from twinstring.llm.words import PUNCTUATION, Block, Lookup, blocks, chain, lists, mix, signed

#: Labelled documents that the model is fitted on at most, those of least hash.
FIT_ROWS = 12_000
PREFIXES = (4, 5, 6, 7, 8)
#: Prior mass, as a share of all counts; standard errors taken off a score.
PRIOR = 0.05
SURE = 2.3
DRIFT = -0.05
THRESHOLD = 0.3


def units(block: Block) -> np.ndarray:
    """Hashes of each token's units, a row each; 0 where a prefix would be the word."""
    return np.stack([block.hashes(), *[block.prefix_hashes(k) for k in PREFIXES]])


def segments(scores: np.ndarray) -> list[float]:
    """Scores of all maximal-scoring segments (Ruzzo and Tompa 1999). A candidate remembers the
    last one before it whose left sum is smaller; the search steps along these, over candidates
    that no later one can join, so the scan is linear."""
    left: list[float] = []
    right: list[float] = []
    smaller: list[int] = []
    total = 0.0
    for x in scores:
        before, total = total, total + x
        if x <= 0:
            continue
        lo, hi = before, total
        j = len(left) - 1
        while j >= 0 and left[j] >= lo:
            j = smaller[j]
        while j >= 0 and right[j] < hi:
            lo = left[j]
            at, j = j, smaller[j]
            del left[at:], right[at:], smaller[at:]
        left.append(lo)
        right.append(hi)
        smaller.append(j)
    return [b - a for a, b in zip(left, right, strict=True)]


class Model:
    """Unit scores, extreme-value parameters and the logistic curve."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray):
        self.lookup = Lookup(keys, scores.astype(np.float32), 0.0)
        self.lam, self.log_k = 1.0, 0.0
        self.slope, self.shift = 1.0, 0.0

    def tokens(self, block: Block) -> np.ndarray:
        best = np.zeros(len(block.starts), np.float32)
        for h in units(block):
            np.maximum(best, self.lookup(h), out=best)
        return np.where(best > 0, best, np.float32(DRIFT))

    def statistics(self, block: Block) -> np.ndarray:
        """Of each row: what its segments exceed the extreme-value level by, summed; none: 0."""
        s = self.tokens(block)
        out = np.zeros(block.n)
        good = np.searchsorted(block.at, np.flatnonzero(s > 0), "right") - 1
        for row in np.unique(good):
            part = s[block.at[row] : block.at[row + 1]]
            where = np.flatnonzero(part > 0)
            # Positive tokens with the whole loss between them: the scan sees both as items.
            gaps = np.diff(where) - 1
            items = np.empty(2 * len(where) - 1)
            items[::2] = part[where]
            items[1::2] = gaps * DRIFT
            level = self.log_k + np.log(len(part))
            out[row] = sum(max(0.0, self.lam * x - level) for x in segments(items))
        return out

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * stats + self.shift, -30, 30)))


def _extreme_values(model: Model, neutral: np.ndarray, n: int) -> None:
    """lambda solves ``sum p exp(lambda s) = 1`` over the scores of neutral tokens, n in all of
    which ``neutral`` are positive. One token at the highest score is added, so that no sample
    can claim that neutral text never scores."""
    s = np.append(neutral, model.lookup.values.max(initial=1.0)).astype(float)
    p = 1.0 / (n + 1)
    f = lambda x: p * np.exp(np.minimum(x * s, 700)).sum() + (1 - p * len(s)) * np.exp(x * DRIFT) - 1
    lo, hi = 1e-6, 20.0
    if f(lo) >= 0:  # neutral text drifts upwards: nothing stands out
        model.lam, model.log_k = 0.1, 0.0
        return
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    model.lam = lo
    # K's usual bound for scores without a lattice: the mean loss times lambda.
    model.log_k = float(np.log(max(1e-6, lo * abs(DRIFT))))


def _logistic(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Newton's method with a ridge of one on slope and shift."""
    a = np.stack([x, np.ones(len(x))], axis=1)
    w = np.array([0.5, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + np.array([1.0, 0.1]) * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1.0, 0.1])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(max(w[0], 1e-3)), float(w[1])


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic, text)`` of at most FIT_ROWS labelled rows outside the held-out fold."""
    ids = (
        plain(labels, doc_id="long", toxic="int")
        .where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 4) != 2))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .join(docs.select(F.col("doc_id").alias("own")), F.col("doc_id") == F.col("own"), "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(FIT_ROWS)
    )
    return docs.join(F.broadcast(stash(ids, "fit-ids")), "doc_id")


_UNITS = "toxic int, sketch long, doc_id long, units array<long>"


def _units(sample: DataFrame) -> DataFrame:
    """Distinct units of each sampled document, and the least hash of its five-word shingles,
    which near copies share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches, parts = [], []
            for b in blocks(batch, "text", PUNCTUATION):
                u = units(b)
                h = u[0]
                z = chain(h, 5)
                for r in range(b.n):
                    lo, hi = b.at[r], b.at[r + 1]
                    own = z[lo : max(lo, hi - 4)] if hi - lo >= 5 else mix(h[lo:hi])
                    sketches.append(int(signed(own.min(keepdims=True))[0]) if len(own) else 0)
                    parts.append(signed(np.setdiff1d(u[:, lo:hi], np.zeros(1, np.uint64))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(sketches, pa.int64()), batch.column(0), lists(parts, pa.int64())],
                ["toxic", "sketch", "doc_id", "units"],
            )

    return sample.select("doc_id", "toxic", "text").mapInArrow(freed(run), _UNITS)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). Of near copies in the
    sample one is counted, or a group of copies would make all its words toxic. Without labels
    of both kinds no unit scores and every document gets the share of toxic labels."""
    sample = _sample(docs, labels)
    each = stash(_units(sample), "fit-units")
    one = each.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id"))
    counted = each.join(F.broadcast(one.select("doc_id").distinct()), "doc_id", "left_semi")
    toxic = F.col("toxic")
    counts = (
        counted.select("toxic", F.explode("units").alias("u"))
        .groupBy("u")
        .agg(F.sum(toxic).alias("t"), F.sum(1 - toxic).alias("c"))
    )
    counts = stash(counts, "fit-counts")
    n = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    model = Model(np.zeros(0, np.uint64), np.zeros(0))
    if n["t"] and n["c"]:
        nt, nc = float(n["t"]), float(n["c"])
        mass = PRIOR * (nt + nc)
        a = F.lit(PRIOR) * (F.col("t") + F.col("c"))
        odds = F.log((F.col("t") + a) / (nt + mass - F.col("t") - a)) - F.log(
            (F.col("c") + a) / (nc + mass - F.col("c") - a)
        )
        sd = F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
        scored = counts.where("t > 1").select("u", (odds - SURE * sd).alias("s")).where("s > 0")
        top = scored.orderBy("u").toArrow()  # units of FIT_ROWS documents, 12 bytes each
        model = Model(top["u"].to_numpy().view(np.uint64), top["s"].to_numpy())
    _calibrate(model, sample)
    return model


def _calibrate(model: Model, sample: DataFrame) -> None:
    """Extreme-value parameters from the sample's neutral documents, then the curve."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def neutral(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shared.value.tokens(b) for b in blocks(batch, "text", PUNCTUATION)]
            s = np.concatenate(s) if s else np.zeros(0, np.float32)
            values, n = np.unique(s, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["s", "n"])

    rows = (
        sample.where("toxic = 0").select("text").mapInArrow(freed(neutral), "s float, n long")
        .groupBy("s").agg(F.sum("n").alias("n")).toArrow()
    )
    s, n = rows["s"].to_numpy(), rows["n"].to_numpy()
    up = s > 0
    _extreme_values(model, np.repeat(s[up], n[up]), int(n.sum()))
    shared.destroy()
    got = _statistics(sample.select("doc_id", "text", "toxic"), model, "toxic").toArrow()
    x, y = got["stat"].to_numpy(), got["toxic"].to_numpy().astype(float)
    if len(x):
        _logistic(model, x, y)


def _statistics(docs: DataFrame, model: Model, *also: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [shared.value.statistics(b) for b in blocks(batch, "text", PUNCTUATION)]
            flat = np.concatenate(stats) if stats else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[batch.column(2 + i) for i in range(len(also))], pa.array(flat)],
                ["doc_id", *also, "stat"],
            )

    extra = "".join(f"{c} int, " for c in also)
    return docs.select("doc_id", "text", *also).mapInArrow(freed(run), f"doc_id long, {extra}stat double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, statistic)`` of every row of ``docs``.

    Whole texts are scanned; null and empty ones have no segment and get the lowest score. Rows
    that repeat are scored each. Null ids are outside the held-out fold. Extra columns, also
    those named like labels, are ignored. An empty table gives an empty result.
    """
    d = plain(docs, doc_id="long", text="string")
    model = fit(d, labels)
    shared_curve = (model.slope, model.shift)
    stats = _statistics(d, model)
    z = F.least(F.greatest(F.lit(shared_curve[0]) * F.col("stat") + shared_curve[1], F.lit(-30.0)), F.lit(30.0))
    score = 1 / (1 + F.exp(-z))
    return stats.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= THRESHOLD).cast("int").alias("predicted"),
        F.col("stat").alias("statistic"),
    )
