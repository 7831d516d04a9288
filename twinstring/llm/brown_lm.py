"""Brown class-based bigram language model.

Probability of a token: class given the previous token's class, times token given its class.
Classes come from exchange clustering of every word of the training documents. It starts from
exchange of bounded units on the driver: the most frequent words, and for all others their shape
(last letters, trailing punctuation). In each following sweep the counts of the classes before and
after every single word meet in one place, and the word moves to the class that raises the
likelihood most; words are dealt over executors and move at once, against the statistics that the
sweep began with. Only words that never occur in training have their shape's class.

All counts are taken over all training documents. The most frequent words' counts and classes are
sent to the executors; rarer words of a text meet theirs in a join, so that the vocabulary, which
grows with the corpus, is never held in one place. During a sweep rarer words count as neighbours
under the class of their shape; the transitions of the model are of the final classes of all words.

The distribution over words of a class is smoothed by half a count, one further half for all
unseen words of the class; transitions back off to the classes' own frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinstring.llm.shared import crc_mod, freed, plain, stash
from twinstring.llm.words import PUNCTUATION, Block, Lookup, blocks, lists, signed, text_column

#: Words that are units of their own at the start; shapes of all others; classes.
UNIT_WORDS = 1024
SHAPES = 256
CLASSES = 64
#: Words whose counts and classes go to the executors: 32 bytes each.
SENT_WORDS = 200_000
#: Pseudo-count of the class frequencies in transitions.
BACKOFF = 20.0
SWEEPS = 6
#: Sweeps over all words, and tokens whose neighbours a task counts at a time.
WORD_SWEEPS = 1
SWEEP_TOKENS = 1 << 21
#: A class that a sequence leaves open.
OPEN = 255
#: The end of a document, which is also what precedes its first word.
END = np.uint64(0x5851F42D4C957F2D)
_END_SHAPE = SHAPES


def shapes(block: Block) -> np.ndarray:
    """Shape of each word: a bucket of its last three bytes before trailing punctuation, and
    whether there is such punctuation."""
    end = block.ends.copy()
    for _ in range(4):
        end -= PUNCTUATION[block.bytes[end - 1]] & (end - 1 > block.starts)
    h = block.spans(np.maximum(block.starts, end - 3), end)
    return ((h % np.uint64(SHAPES // 2)).astype(np.int64) * 2) + (end < block.ends)


def _with_ends(block: Block, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values of the words with one for the end of each row; and where rows end in that."""
    stop = block.at[1:]
    return np.insert(values, stop, end), stop + np.arange(1, block.n + 1)


def _count_words(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ss = [], []
            for b in blocks(batch, "text"):
                hs.append(_with_ends(b, b.hashes(), END)[0])
                ss.append(_with_ends(b, shapes(b), _END_SHAPE)[0])
            h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
            s = np.concatenate(ss) if ss else np.zeros(0, np.int64)
            h, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(h)), pa.array(s[at].astype(np.int32)), pa.array(n.astype(np.int64))],
                ["h", "shape", "n"],
            )

    words = train.select("text").mapInArrow(freed(run), "h long, shape int, n long")
    return words.groupBy("h", "shape").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words with their counts, and everyone's unit."""

    def __init__(self, h: np.ndarray, shape: np.ndarray, n: np.ndarray):
        self.hashes, self.counts = h, n.astype(np.float64)
        self.rank = Lookup(h, np.arange(len(h)), -1)
        self.words = min(UNIT_WORDS, len(h))
        self.unit = np.where(np.arange(len(h)) < self.words, np.arange(len(h)), UNIT_WORDS + shape)
        self.units = UNIT_WORDS + SHAPES + 1

    def look(self, h: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each word, -1 if it isn't among these, and its unit."""
        r = self.rank(h)
        if not len(self.unit):
            return r, UNIT_WORDS + shape
        return r, np.where(r >= 0, self.unit[np.maximum(r, 0)], UNIT_WORDS + shape)


class Classes:
    """Class of each of the most frequent words, and of the shapes of all others."""

    def __init__(self, vocabulary: Vocabulary, cls: np.ndarray, shape_cls: np.ndarray):
        self.vocabulary, self.cls, self.shape_cls = vocabulary, cls, shape_cls

    def look(self, b: Block) -> tuple[np.ndarray, ...]:
        """Hash, rank and class of every token of a block, the ends included; and where rows
        end."""
        h, stop = _with_ends(b, b.hashes(), END)
        s, _ = _with_ends(b, shapes(b), _END_SHAPE)
        r = self.vocabulary.rank(h)
        c = self.shape_cls[s]
        if len(self.cls):
            c = np.where(r >= 0, self.cls[np.maximum(r, 0)], c)
        return h, r, c, stop

    def moved(self, words: DataFrame) -> Classes:
        """With the classes of ``words`` (h, cls) for the most frequent ones."""
        v = self.vocabulary
        ids = words.sparkSession.createDataFrame(pa.table({"h": signed(v.hashes)}))
        got = words.join(F.broadcast(ids), "h", "left_semi").select("h", "cls").toArrow()
        cls = self.cls.copy()
        cls[v.rank(got["h"].to_numpy().view(np.uint64))] = got["cls"].to_numpy()
        return Classes(v, cls, self.shape_cls)


def _tokens(vocabulary: Vocabulary, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Unit of every token of a block, the ends included, and the unit before each."""
    h, _ = _with_ends(b, b.hashes(), END)
    s, _ = _with_ends(b, shapes(b), _END_SHAPE)
    _, u = vocabulary.look(h, s)
    before = np.empty_like(u)
    before[1:] = u[:-1]
    before[:1] = vocabulary.look(np.array([END]), np.array([_END_SHAPE]))[1][0]
    return u, before


def _count_pairs(train: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Counts of neighbouring units over all of ``train``: units squared at most."""
    shared = train.sparkSession.sparkContext.broadcast(vocabulary)
    size = vocabulary.units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(size * size, np.int64)
            for b in blocks(batch, "text"):
                u, before = _tokens(shared.value, b)
                total += np.bincount(before * size + u, minlength=size * size)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"]
            )

    pairs = train.select("text").mapInArrow(freed(run), "pair int, n long").groupBy("pair")
    got = pairs.agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: exchange clustering for the most likely class bigram model. Each unit
    in turn, frequent ones first, moves to the class that raises the likelihood most, until a
    sweep moves none."""
    n_units = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    order = order[weight[order] > 0]
    cls = np.zeros(n_units, np.int64)
    cls[order] = np.arange(len(order)) % classes
    one = np.eye(classes)[cls]
    right, left = pairs @ one, pairs.T @ one  # of each unit: counts with classes after, before
    a = one.T @ right
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    for _ in range(sweeps):
        moved = 0
        for u in order:
            own, r, lf, self_ = cls[u], right[u].copy(), left[u].copy(), pairs[u, u]
            r[own] -= self_
            lf[own] -= self_
            # without u
            a[own] -= r
            a[:, own] -= lf
            a[own, own] -= self_
            row, col = a.sum(1), a.sum(0)
            grown_row, grown_col = a + r[None, :], a.T + lf[None, :]
            gain = (f(grown_row) - f(a)).sum(1) + (f(grown_col) - f(a.T)).sum(1)
            d = np.arange(classes)
            x = a[d, d]
            gain += f(x + r + lf + self_) - f(x + r) - f(x + lf) + f(x)
            gain -= f(row + r.sum() + lf + self_) - f(row)
            gain -= f(col + lf.sum() + r + self_) - f(col)
            # rows and columns of the other classes keep their sums but for u's own part
            others_r, others_l = f(col + r) - f(col), f(row + lf) - f(row)
            gain -= others_r.sum() - others_r + others_l.sum() - others_l
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = int(own)
            a[best] += r
            a[:, best] += lf
            a[best, best] += self_
            if best != own:
                moved += 1
                cls[u] = best
                right[:, own] -= pairs[:, u]
                right[:, best] += pairs[:, u]
                left[:, own] -= pairs[u, :]
                left[:, best] += pairs[u, :]
        if not moved:
            break
    return cls


_CELL = np.dtype([("cell", "u1"), ("n", "<u4")])
_NEIGHBOURS = "h long, own int, cells binary"


def _neighbours(train: DataFrame, classes: Classes) -> DataFrame:
    """``(h, own, cells)`` of every word: its class, and counts of the classes before it (cells
    from 0) and after it (cells from CLASSES), in several rows."""
    shared = train.sparkSession.sparkContext.broadcast(classes)

    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, r, c, before, after = (np.concatenate(x) for x in zip(*parts, strict=True))
        sent = len(shared.value.cls)
        rest = np.flatnonzero(r < 0)
        rare, at = np.unique(h[rest], return_inverse=True)
        r[rest] = sent + at
        own = np.zeros(sent + len(rare), np.int32)
        own[r] = c
        names = np.concatenate([shared.value.vocabulary.hashes, rare])
        key = r * (2 * CLASSES)
        key, n = np.unique(np.concatenate([key + before, key + CLASSES + after]), return_counts=True)
        word = key // (2 * CLASSES)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        cells = np.empty(len(key), _CELL)
        cells["cell"], cells["n"] = key % (2 * CLASSES), n
        off = (np.append(first, len(key)) * _CELL.itemsize).astype(np.int32)
        word = word[first]
        data = pa.BinaryArray.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(off), pa.py_buffer(cells)])
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(names[word])), pa.array(own[word]), data], ["h", "own", "cells"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for b in blocks(batch, "text"):
                h, r, c, _ = shared.value.look(b)
                # the last end of a block stands before its first word
                parts.append((h, r, c, np.roll(c, 1), np.roll(c, -1)))
                size += len(h)
                if size >= SWEEP_TOKENS:
                    yield packed(parts)
                    parts, size = [], 0
        if parts:
            yield packed(parts)

    return train.select("text").mapInArrow(freed(run), _NEIGHBOURS)


def best_classes(a: np.ndarray, own: np.ndarray, word: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class in which each word makes the class bigram model likeliest, by the transitions ``a``
    that hold it in class ``own``. ``word, cell, n``: its counts of neighbours' classes, sorted
    by word; each word has some."""
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    m, k = len(own), len(a)
    d = np.arange(k)
    near = np.zeros((m, 2 * k))
    near[word, cell] = n
    c, after = cell % k, cell >= k
    x = np.where(after[:, None], a[:, c].T, a[c])
    e = np.arange(len(word))
    x[e, own[word]] -= n
    # the word's own class as a neighbour: without the word on the other side
    for side, other in ((after, near[:, :k]), (~after, near[:, k:])):
        at = np.flatnonzero(side & (c == own[word]))
        x[at] -= other[word[at]]
    x = np.maximum(x, 0)
    grown = f(x + n[:, None]) - f(x)
    grown[e, c] = 0  # a class's transitions to itself grow by both sides
    gain = np.add.reduceat(grown, np.searchsorted(word, np.arange(m)))

    def more(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x = np.broadcast_to(x, (m, k)).copy()
        i = np.arange(m)
        x[i, own] = np.maximum(x[i, own] - np.broadcast_to(y, (m, k))[i, own], 0)
        return f(x + y) - f(x)

    gain += more(a[d, d], near[:, :k] + near[:, k:])
    gain -= more(a.sum(1), near[:, k:].sum(1, keepdims=True))
    gain -= more(a.sum(0), near[:, :k].sum(1, keepdims=True))
    best = gain.argmax(1)
    i = np.arange(m)
    return np.where(gain[i, best] > gain[i, own] + 1e-9, best, own)


def _sweep(train: DataFrame, classes: Classes) -> DataFrame:
    """``(h, n, cls)`` of every word of ``train``: its count, and its class after a sweep."""
    spark = train.sparkSession
    near = stash(_neighbours(train, classes), "neighbours")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, own, row, cells = _unpack(batch)
            left = cells["cell"] < CLASSES
            pair = cells["cell"][left].astype(np.int64) * CLASSES + own[row[left]]
            n = np.bincount(pair, weights=cells["n"][left], minlength=CLASSES * CLASSES)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["pair", "n"])

    shared = spark.sparkContext.broadcast(_matrix(near.mapInArrow(freed(total), "pair int, n long")))

    def moves(h: np.ndarray, own: np.ndarray, row: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(new) - 1
        key = group[row] * (2 * CLASSES) + cells["cell"]
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, weights=cells["n"])
        word, cell = key // (2 * CLASSES), key % (2 * CLASSES)
        cls = best_classes(shared.value, own[new], word, cell, n)
        left = cell < CLASSES
        count = np.bincount(word[left], weights=n[left], minlength=int(new.sum()))
        return pa.RecordBatch.from_arrays(
            [pa.array(h[new]), pa.array(count.astype(np.int64)), pa.array(cls.astype(np.int32))], ["h", "n", "cls"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the last word, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            h, own, row, cells = _unpack(batch)
            held.append((h, own, row, cells))
            if h[0] == h[-1] and held[0][0][-1] == h[0]:
                continue
            h, own, row, cells = _joined(held)
            last = int(np.flatnonzero(h != h[-1])[-1]) + 1
            cut = np.searchsorted(row, last)
            yield moves(h[:last], own[:last], row[:cut], cells[:cut])
            held = [(h[last:], own[last:], row[cut:] - last, cells[cut:])]
        if held:
            yield moves(*_joined(held))

    by_word = near.repartition("h").sortWithinPartitions("h")
    return stash(by_word.mapInArrow(freed(run), "h long, n long, cls int"), "classes")


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Words, their classes, and the row and content of every cell."""
    data, off = text_column(batch, "cells")
    cells = np.frombuffer(data[off[0] : off[-1]].tobytes(), _CELL)
    row = np.repeat(np.arange(batch.num_rows), np.diff(off) // _CELL.itemsize)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), row, cells


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    shift = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
    h, own, row, cells = zip(*parts, strict=True)
    return np.concatenate(h), np.concatenate(own), np.concatenate([r + s for r, s in zip(row, shift, strict=True)]), np.concatenate(cells)


def _matrix(pairs: DataFrame) -> np.ndarray:
    """Transitions between classes from ``(pair, n)``."""
    got = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


class Model:
    def __init__(self, a: np.ndarray, freq: np.ndarray, words: np.ndarray, end: int):
        prior = (freq + 0.5) / (freq.sum() + 0.5 * CLASSES)
        self.log_move = np.log10((a + BACKOFF * prior) / (a.sum(1, keepdims=True) + BACKOFF))
        self.log_class = np.log10(freq + 0.5 * (words + 1))
        self.end = end

    def score(self, c: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Of each row: the model's score but for the counts of its words."""
        before = np.roll(c, 1)
        before[:1] = self.end
        each = self.log_move[before, c] - self.log_class[c]
        return np.add.reduceat(each, start) if len(start) else np.zeros(0)


_PARTIAL = "row long, doc_id long, n_tokens long, n_known long, counts double, seq binary, alt binary, rest array<long>"


def _bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], ends]).astype(np.int32)
    data = values.astype(np.uint8)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(off), pa.py_buffer(data)])


def _partial(docs: DataFrame, classes: Classes) -> DataFrame:
    """Of each row: the classes of its tokens, OPEN where a word isn't among the most frequent;
    those words, and the classes that they have if they don't occur in training."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            log_count = np.log10(shared.value.vocabulary.counts + 0.5)
            for b in blocks(batch, "text"):
                h, r, c, stop = shared.value.look(b)
                known = r >= 0
                start = np.concatenate([[0], stop[:-1]])
                part = np.where(known, log_count[np.maximum(r, 0)] if len(log_count) else 0.0, 0.0)
                rest = np.flatnonzero(~known)
                ends = np.searchsorted(rest, stop)
                cols[0].append(stop - start)
                cols[1].append(np.add.reduceat(known.astype(np.int64), start))
                cols[2].append(np.add.reduceat(part, start))
                cols[3].append(_bytes(np.where(known, c, OPEN), stop))
                cols[4].append(_bytes(c[rest], ends))
                cols[5].extend(np.split(signed(h[rest]), ends[:-1]))
            kinds = (np.int64, np.int64, np.float64)
            made = [pa.array(np.concatenate(c).astype(t) if c else np.zeros(0, t)) for c, t in zip(cols, kinds, strict=False)]
            made += [pa.concat_arrays(c) if c else pa.array([], pa.binary()) for c in cols[3:5]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *made, lists(cols[5], pa.int64())],
                ["row", "doc_id", "n_tokens", "n_known", "counts", "seq", "alt", "rest"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return stash(rows.mapInArrow(freed(run), _PARTIAL), "scored")


def _sequences(part: DataFrame, words: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, n_known, counts, seq)``: the classes of all tokens of each row, and
    the sum of the logarithms of its words' counts."""
    rare = part.select("row", F.posexplode("rest").alias("k", "h"))
    found = (
        rare.join(words.hint("merge"), "h")
        .groupBy("row")
        .agg(
            F.sum(F.log10(F.col("n") + 0.5)).alias("more"),
            F.collect_list(F.col("k").cast("long") * 256 + F.col("cls")).alias("at"),
        )
    )
    also = F.when(F.col("at").isNull(), 0).otherwise(F.size("at"))
    unseen = F.length("alt") - also
    both = part.drop("rest").join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + also).alias("n_known"),
        (F.col("counts") + F.coalesce("more", F.lit(0.0)) + unseen * float(np.log10(0.5))).alias("counts"),
        "seq",
        "alt",
        F.coalesce("at", F.array().cast("array<long>")).alias("at"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, off = text_column(batch, "seq")
            seq, off = seq[off[0] : off[-1]].copy(), off - off[0]
            alt, first = text_column(batch, "alt")
            alt, first = alt[first[0] : first[-1]].copy(), first - first[0]
            at = batch.column(batch.schema.get_field_index("at"))
            code = at.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), at.value_lengths().to_numpy())
            alt[first[row] + (code >> 8)] = code & 255
            seq[seq == OPEN] = alt
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], _bytes(seq, off[1:])], ["doc_id", "n_tokens", "n_known", "counts", "seq"]
            )

    schema = "doc_id long, n_tokens long, n_known long, counts double, seq binary"
    return stash(both.mapInArrow(freed(run), schema), "sequences")


def _held(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 5) == 1, F.lit(False))


def _transitions(seqs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_column(batch, "seq")
            c = data[off[0] : off[-1]].astype(np.int64)
            n = np.bincount(np.roll(c, 1) * CLASSES + c, minlength=CLASSES * CLASSES)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["pair", "n"])

    return _matrix(seqs.select("seq").mapInArrow(freed(run), "pair int, n long"))


def fit(train: DataFrame) -> tuple[Classes, DataFrame, int, int]:
    """The most frequent words' classes, the table ``(h, n, cls)`` of all words, and the numbers
    of tokens and words."""
    counts = stash(_count_words(train), "words")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy((F.col("h") != int(signed(np.array([END]))[0])), F.desc("n"), "h").limit(SENT_WORDS).toArrow()
    h = top["h"].to_numpy().view(np.uint64)
    vocabulary = Vocabulary(h, top["shape"].to_numpy(), top["n"].to_numpy())
    cls = exchange(_count_pairs(train, vocabulary))
    classes = Classes(vocabulary, cls[vocabulary.unit], cls[UNIT_WORDS:])
    for _ in range(WORD_SWEEPS):
        words = _sweep(train, classes)
        classes = classes.moved(words)
    return classes, words, int(total["n"] or 0), int(total["v"])


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Whole texts count, null as empty; an empty text is its end alone. Scores are log10
    probabilities: score of the class model, base_score of the unigram model. Rows that repeat
    are scored, and trained on, each; rows of a null id are trained on. An empty table, or one
    without training rows, is scored from smoothing alone. Extra columns are ignored.
    """
    d = plain(docs, doc_id="long", text="string")
    classes, words, total, distinct = fit(d.where(~_held(F.col("doc_id"))))
    seqs = _sequences(_partial(d, classes), words)
    freq, size = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        freq[r["cls"]], size[r["cls"]] = r["n"], r["v"]
    held = _held(F.col("doc_id"))
    end = classes.cls[0] if len(classes.cls) else classes.shape_cls[_END_SHAPE]
    shared = d.sparkSession.sparkContext.broadcast(Model(_transitions(seqs.where(~held)), freq, size, int(end)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_column(batch, "seq")
            full = shared.value.score(data[off[0] : off[-1]], off[:-1] - off[0])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(full)], ["doc_id", "n_tokens", "n_known", "counts", "full"]
            )

    scored = seqs.mapInArrow(freed(run), "doc_id long, n_tokens long, n_known long, counts double, full double")
    base = float(np.log10(total + 0.5 * (distinct + 1)))
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("counts") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("counts") + F.col("full")).alias("score"),
    )
