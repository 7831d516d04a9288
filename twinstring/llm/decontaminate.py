"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document is contaminated by an item if some passage of it is within a word edit distance of
``budget(n)``, a fifth of the item's n words. Windows that start at any word of a text are
embedded by random walks (a walk stays at a word or passes it by a random bit of the word and the
step), which turn edit distance into Hamming distance. In each of many repetitions the key of an
item is a sample of BITS positions of its embedding, up to where its walk passes its last word;
windows of equal key are candidates, and are verified by exact alignment.

Windows are not embedded one by one to look their keys up. Equal keys have equal words at every
sampled step, so from each occurrence of an item's rarest sampled word the walk is traced back to
all starts that lead there, and those walk forward along the other sampled steps. That finds the
very windows whose keys are equal, and costs nothing where a block of text lacks a sampled word.

The number of repetitions is set by searching altered copies of the benchmark's own items, with
as many edits as they may have, until RECALL of them are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinstring.llm.shared import freed, plain
from twinstring.llm.words import PUNCTUATION, Block, Lookup, blocks, chain, mix

SIMILARITY = 0.8
#: Letters of scripts that put no spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Share of passages with a full budget of edits, of whatever kind, that the repetitions must find.
RECALL = 0.92
#: Positions sampled in a repetition.
BITS = 6
#: Repetitions that the share of found copies is measured with, and altered copies.
PROBE_REPEATS = 96
PROBES = 300
#: Words of a piece at most: longer items are embedded in pieces, of which one at least has no more
#: than its share of the edits, and verified whole.
PIECE_WORDS = 128
#: Items, and words of items, that go to the executors at a time; more are taken in blocks.
ITEM_BLOCK = 1_000
ITEM_WORDS = 500_000
#: Walks that are traced at a time.
WALKS = 1 << 18


def budget(n: int) -> int:
    """Word edits that a passage of an item of n words may have."""
    return int(n * (1 - SIMILARITY) + 1e-9)


def _bit(symbol: np.ndarray, repeat, step) -> np.ndarray:
    """The walk's bit for a word at a step of a repetition."""
    salt = (np.asarray(repeat, np.uint64) * np.uint64(1_000_003) + np.uint64(step)) * np.uint64(2) + np.uint64(1)
    return (mix(symbol + salt) & np.uint64(1)).astype(np.int64)


def walks(words: np.ndarray, n: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """CGK walks over the rows of ``words``, of which the first ``n`` count: where each is at every
    step, and the number of steps until it has passed its last word."""
    m = len(words)
    at = np.zeros(m, np.int64)
    path = []
    rows = np.arange(m)
    while (at < n).any():
        path.append(at.astype(np.int32))
        symbol = words[rows, np.minimum(at, words.shape[1] - 1)]
        at = np.minimum(at + _bit(symbol, repeat, len(path) - 1), n)
    path = np.stack(path, axis=1)
    return path, (path < n[:, None]).sum(axis=1)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the passage, and where the stretch
    ends: Sellers' recurrence, a row at a time."""
    m = len(passage)
    ramp = np.arange(m + 1)
    row = np.zeros(m + 1, np.int64)
    for i, word in enumerate(item, 1):
        best = np.empty(m + 1, np.int64)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (passage != word))
        row = np.minimum.accumulate(best - ramp) + ramp
    end = int(np.argmin(row))
    return int(row[end]), end


class Items:
    """What the executors need of a block of benchmark items: their words, and of each piece, for
    each of ``repeats`` repetitions, the sampled steps and the words there."""

    def __init__(self, ids: list[int], words: list[np.ndarray], repeats: int | None = None):
        self.ids, self.words = ids, words
        self.n = np.array([len(w) for w in words], np.int64)
        self.k = np.array([budget(len(w)) for w in words], np.int64)
        names = np.unique(np.concatenate(words))
        cuts = [np.linspace(0, len(w), -(-len(w) // PIECE_WORDS) + 1).astype(int) for w in words]
        self.pieces = [w[a:b] for w, c in zip(words, cuts, strict=True) for a, b in zip(c[:-1], c[1:], strict=True)]
        self.piece_item = np.repeat(np.arange(len(words)), [len(c) - 1 for c in cuts])
        self.piece_at = np.concatenate([c[:-1] for c in cuts])
        self.size = np.array([len(w) for w in self.pieces], np.int64)
        self.vocabulary = Lookup(names, np.arange(len(names), dtype=np.int32), -1)
        self.repeats = 0
        self.steps = np.zeros((len(self.pieces), 0, BITS), np.int16)
        self.names = np.zeros((len(self.pieces), 0, BITS), np.int32)
        self._extend(repeats or PROBE_REPEATS)
        if repeats is None:
            need = self._needed()
            if need > self.repeats:
                self._extend(need)
            self.repeats = need
            self.steps, self.names = self.steps[:, :need].copy(), self.names[:, :need].copy()

    def _extend(self, repeats: int) -> None:
        """Keys of the repetitions up to ``repeats``; pieces of like size walk together."""
        shape = (len(self.pieces), repeats - self.repeats, BITS)
        steps, names = np.zeros(shape, np.int16), np.zeros(shape, np.int32)
        order = np.argsort(self.size, kind="stable")
        size = self.size[order]
        i = 0
        while i < len(order):
            some = order[i : min(int(np.searchsorted(size, 2 * size[i], "right")), i + 4096)]
            i += len(some)
            matrix = np.zeros((len(some), int(self.size[some].max())), np.uint64)
            for row, piece in enumerate(some):
                matrix[row, : self.size[piece]] = self.pieces[piece]
            rows = np.arange(len(some))[:, None]
            for r in range(self.repeats, repeats):
                path, length = walks(matrix, self.size[some], r)
                u = np.sort(np.random.default_rng(r).random(BITS))
                step = (u[None, :] * length[:, None]).astype(np.int64)
                steps[some, r - self.repeats] = step
                names[some, r - self.repeats] = self.vocabulary(matrix[rows, path[rows, step]])
        self.steps = np.concatenate([self.steps, steps], axis=1)
        self.names = np.concatenate([self.names, names], axis=1)
        self.repeats = repeats

    def _needed(self) -> int:
        """Repetitions that reach RECALL for the worst kind of edits: altered copies of pieces, each
        between words of its own, are searched, and each repetition's finds counted."""
        rng = np.random.default_rng(7)
        pick = rng.choice(len(self.pieces), PROBES)
        rows = []
        for probe, i in enumerate(pick):
            w = list(self.pieces[i])
            for _ in range(budget(len(w))):
                j = int(rng.integers(len(w)))
                kind = probe % 3
                new = np.uint64(rng.integers(1, 1 << 62))
                if kind == 0:
                    w[j] = new
                elif kind == 1 and len(w) > 1:
                    del w[j]
                else:
                    w.insert(j, new)
            pad = rng.integers(1, 1 << 62, 2 * len(w)).astype(np.uint64)
            rows.append(np.concatenate([pad[: len(w)], np.array(w, np.uint64), pad[len(w) :]]))
        at = np.cumsum([0, *map(len, rows)])
        found = np.concatenate([np.zeros((0, 4), np.int64), *self.candidates(np.concatenate(rows), at)])
        own = found[found[:, 0] == pick[found[:, 1]]]
        hits = np.bincount(np.unique(own[:, [1, 3]], axis=0)[:, 0], minlength=len(pick))
        p = (hits + 0.25) / (self.repeats + 0.5)
        worst = lambda r: min((1 - (1 - p[kind::3]) ** r).mean() for kind in range(3))
        few, many = 1, 1
        while worst(many) < RECALL:
            few, many = many, 2 * many
        while few < many:
            mid = (few + many) // 2
            few, many = (few, mid) if worst(mid) >= RECALL else (mid + 1, many)
        return many

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """(piece, row, start, repetition) of the windows whose keys are those of pieces, some
        perhaps more than once. ``h``: words of rows that begin at ``bounds``."""
        v = self.vocabulary(h)
        known = np.flatnonzero(v >= 0)
        count = np.bincount(v[known], minlength=len(self.vocabulary.keys))
        if not len(known):
            return
        order = known[np.argsort(v[known], kind="stable")]
        first = np.cumsum(count) - count
        width = len(h) + 1
        places = v[order].astype(np.int64) * width + order  # ascending: by word, then by place
        each = count[self.names]
        item, repeat = np.nonzero(each.min(axis=2) > 0)
        if not len(item):
            return
        anchor = each[item, repeat].argmin(axis=1)
        name = self.names[item, repeat, anchor]
        n_hits = count[name]
        ends = np.cumsum(n_hits)
        for lo in range(0, int(ends[-1]), WALKS):
            hit = np.arange(lo, min(lo + WALKS, int(ends[-1])))
            g = np.searchsorted(ends, hit, "right")
            at = order[first[name[g]] + hit - (ends[g] - n_hits[g])]
            step = self.steps[item[g], repeat[g], anchor[g]].astype(np.int64)
            # A walk moves by one word a step at most: each sampled word must be as near as that.
            for b in range(BITS):
                there = self.names[item[g], repeat[g], b].astype(np.int64) * width
                ahead = self.steps[item[g], repeat[g], b] - step
                i = np.searchsorted(places, there + np.maximum(at + np.minimum(ahead, 0), 0))
                near = places[np.minimum(i, len(places) - 1)]
                near = (near >= there) & (near <= there + at + np.maximum(ahead, 0)) & (i < len(places))
                g, at, step = g[near], at[near], step[near]
            found = self._traced(h, v, bounds, item[g], repeat[g], step, at)
            if len(found):
                yield found

    def _traced(
        self, h: np.ndarray, v: np.ndarray, bounds: np.ndarray, item: np.ndarray, repeat: np.ndarray, step: np.ndarray, at: np.ndarray
    ) -> np.ndarray:
        """Candidates whose walk of repetition ``repeat`` is at word ``at`` at step ``step``."""
        row = np.searchsorted(bounds, at, "right") - 1
        begin, end = bounds[row], bounds[row + 1]
        # Starts that lead to a word are neighbours, as walks never pass one another.
        lo, hi = at.copy(), at.copy()
        live = np.arange(len(at))
        for t in range(int(step.max(initial=0)) - 1, -1, -1):
            on = live[step[live] > t]
            if not len(on):
                continue
            a, b, r = lo[on], hi[on], repeat[on]
            a = np.where((a > begin[on]) & (_bit(h[np.maximum(a - 1, 0)], r, t) == 1), a - 1, a)
            b = b - _bit(h[b], r, t)
            lo[on], hi[on] = a, b
            if (a > b).any():
                live = live[lo[live] <= hi[live]]
        size = hi[live] - lo[live] + 1
        each = np.repeat(live, size)
        start = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + lo[each]
        item, repeat, row, end = item[each], repeat[each], row[each], end[each]
        steps, names = self.steps[item, repeat], self.names[item, repeat]
        p = start.copy()
        live = np.arange(len(each))
        good = np.ones(len(each), bool)
        last = steps.max(axis=1)
        for t in range(int(last.max(initial=-1)) + 1):
            inside = p[live] < end[live]
            word = v[np.minimum(p[live], len(v) - 1)]
            due = steps[live] == t
            ok = ~(due & ((names[live] != word[:, None]) | ~inside[:, None])).any(axis=1)
            good[live[~ok]] = False
            live = live[ok & (last[live] > t) & inside]
            if not len(live):
                break
            p[live] += _bit(h[p[live]], repeat[live], t)
        # A walk that left the text before its last step has no word there.
        good &= (p < end)
        return np.stack([item, row, start, repeat], axis=1)[good]

    def search(self, block: Block) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, distance, end): items that a row of the block holds."""
        h = block.hashes()
        parts = [np.unique(c[:, :3], axis=0) for c in self.candidates(h, block.at)]
        if not parts:
            return
        near = np.concatenate(parts)
        near[:, 2] -= self.piece_at[near[:, 0]]  # where the whole item would begin
        near[:, 0] = self.piece_item[near[:, 0]]
        near = np.unique(near, axis=0)
        for item, row in np.unique(near[:, :2], axis=0):
            at = near[(near[:, 0] == item) & (near[:, 1] == row), 2]
            lo, hi = block.at[row], block.at[row + 1]
            n, k = self.n[item], self.k[item]
            best = (k + 1, 0)
            reach = None
            for s in np.unique(at):  # left to right; stretches that overlap are aligned once
                a, b = max(lo, s - k), min(hi, s + n + k)
                if reach is not None and b <= reach:
                    continue
                reach = b + n
                d, end = align(self.words[item], h[a : min(hi, reach)])
                best = min(best, (d, int(a - lo + end)))
            if best[0] <= k:
                yield int(row), int(item), int(best[0]), best[1]


def by_character(block: Block) -> Block:
    """The block with every character as a word, but for separators."""
    lead = (block.bytes & 0xC0) != 0x80
    lead &= ~PUNCTUATION[block.bytes]
    stop = np.flatnonzero(np.append((block.bytes & 0xC0) != 0x80, True))
    block.starts = np.flatnonzero(lead)
    block.ends = stop[np.searchsorted(stop, block.starts, "right")]
    block.at = np.searchsorted(block.starts, block.offsets)
    return block


def _in_blocks(rows: Iterator) -> Iterator[list]:
    """Items in blocks of ITEM_BLOCK, or of about ITEM_WORDS words, which bound what is sent."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += len(r["text"]) // 5
        if len(part) == ITEM_BLOCK or size >= ITEM_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _items(rows: list) -> list[tuple[Items, bool]]:
    """The items that are searched by word, and those by character."""
    found: dict[bool, tuple[list, list]] = {}
    for r in rows:
        batch = pa.RecordBatch.from_arrays([pa.array([r["text"]], pa.string())], ["t"])
        letters = sum(c.isalnum() for c in r["text"])
        chars = 2 * len(UNSPACED.findall(r["text"])) > letters
        for b in blocks(batch, "t", PUNCTUATION, max(1, len(r["text"].encode()))):
            w = (by_character(b) if chars else b).hashes()
            if len(w):
                ids, words = found.setdefault(chars, ([], []))
                ids.append(r["item_id"])
                words.append(w)
    return [(Items(*x), chars) for chars, x in found.items()]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, distance, n_words, end_word)``: each benchmark item that a document
    holds within the edit budget, with its best alignment, which ends before ``end_word``.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case; for an item
    that is mostly in a script without spaces every character is a word, in the document too.
    Items under five words are found exactly only, as their budget is 0. Null and empty items
    and empty documents match nothing. Rows that repeat
    give their hits as often. Extra columns are ignored. The benchmark is a query set: it is
    sent to the documents in blocks of ITEM_BLOCK items.
    """
    spark = docs.sparkSession
    docs = plain(docs, doc_id="long", text="string")
    b = plain(benchmark, item_id="long", text="string").where("text IS NOT NULL").distinct()
    schema = "doc_id long, item_id long, distance int, n_words int, end_word long"
    out = None
    for part in _in_blocks(b.orderBy("item_id", "text").toLocalIterator()):
        for items, chars in _items(part):
            shared = spark.sparkContext.broadcast(items)

            def run(batches: Iterator[pa.RecordBatch], shared=shared, chars=chars) -> Iterator[pa.RecordBatch]:
                items = shared.value
                for batch in batches:
                    found = []
                    for block in blocks(batch, "text", PUNCTUATION):
                        block = by_character(block) if chars else block
                        found.extend((block.first + r, *x) for r, *x in items.search(block))
                    ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array([items.ids[f[1]] for f in found], pa.int64()),
                            pa.array([f[2] for f in found], pa.int32()),
                            pa.array([int(items.n[f[1]]) for f in found], pa.int32()),
                            pa.array([f[3] for f in found], pa.int64()),
                        ],
                        ["doc_id", "item_id", "distance", "n_words", "end_word"],
                    )

            hits = docs.mapInArrow(freed(run), schema)
            out = hits if out is None else out.unionByName(hits)
    return out if out is not None else docs.limit(0).select(
        "doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance"), F.lit(0).alias("n_words"), F.lit(0).cast("long").alias("end_word")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all its columns) whose document holds no benchmark item. Rows with
    a null doc_id stay."""
    bad = benchmark_hits(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"] == bad["doc_id"], "left_anti")
