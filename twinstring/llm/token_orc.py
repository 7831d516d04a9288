"""Token ids in ORC files that are split, pruned and read by stripe.

Documents are dealt by ranges of doc_id and sorted, so that files and stripes cover disjoint
ranges; ids are integer run-length encoded, and every stripe has a row index and a Bloom filter
on doc_id. A reader of some documents skips files and stripes by minimum and maximum, then row
groups by Bloom filter; a reader of all gets one task per stripe or so.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinstring.llm.shared import freed, plain, shared_dir
from twinstring.llm.words import text_column

END_ID = 2
#: Pieces whose ids a worker remembers, in two generations of this many (some 130 MB in all).
REMEMBERED = 200_000
#: Punctuation that never joins the letters or digits before it in one pre-token.
_BEHIND = "!#$%&*+,-./:;=?@^_|~)]}"
_IS_BEHIND = np.array([chr(i) in _BEHIND for i in range(256)])
_IS_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
ORC_OPTIONS = {
    "compression": "snappy",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
}
_SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"
#: Parts whose offsets may be broadcast when reading; checked by a count.
PARTS_BROADCAST = 200_000


def _symbols() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: printable Latin-1 characters
    stand for themselves, the others for 256 onwards, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_SYMBOLS = _symbols()


class _Memory(dict):
    """Ids of words; a word that it lacks is learnt when it is asked for."""

    __slots__ = ("learn",)

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        return self.learn(word)


class Encoder:
    """A byte-level BPE tokenizer that encodes each distinct word once.

    The split into pre-tokens never joins a word to what precedes it but for one space, so
    the ids of a text whose only white space is single spaces and line ends are those of its
    words, with the space before them, one after the other. Any other text, and one that holds
    a string of the tokenizer's added tokens, is encoded whole.
    """

    def __init__(self, json: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.model = self.tokenizer.model
        self.known = _Memory(self._learn)
        self.before: dict[str, bytes] = {}
        #: Strings that the tokenizer takes out of a text before it splits the rest.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in got]

    def _part(self, part: str) -> bytes:
        """Ids of letters, with a space before them or not, from the model alone: they are one
        pre-token, and the steps around the model would take most of the time. Ids of anything
        else, which is rare, from the whole tokenizer."""
        ids = self.known.get(part) or self.before.get(part)
        if ids is None:
            if part.isascii():
                symbols = part.replace(" ", _SYMBOLS[32])
            else:
                symbols = part.encode("utf-8").decode("latin-1").translate(_SYMBOLS)
            if part.removeprefix(" ").isalpha():
                ids = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
            else:
                ids = self._ids([part])[0]
        self.known[part] = ids
        return ids

    def _learn(self, word: str) -> bytes:
        """Ids of a word that ``known`` lacks, put together from its letters and the punctuation
        behind them, which is a pre-token of its own."""
        ids = self.before.get(word)
        if ids is None:
            stem = word.rstrip(_BEHIND)
            if 1 < len(stem) < len(word) and stem[-1].isalnum():
                ids = self._part(stem) + self._part(word[len(stem) :])
            else:
                ids = self._part(word)
        self.known[word] = ids
        return ids

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text, null as an empty one, as little-endian 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, _Memory(self._learn)
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        data, off = text_column(batch, "text")
        data, off = data[off[0] : off[-1]], off - off[0]
        odd = np.zeros(len(off) - 1, bool)
        odd[np.searchsorted(off, _odd_space(data, off), "right") - 1] = True
        for token in self.added:
            odd |= pc.match_substring(column, token).fill_null(False).to_numpy(zero_copy_only=False)
        out = self._by_words(data, off)
        at = np.flatnonzero(odd)
        for i, ids in zip(at, self._ids([column[int(i)].as_py() for i in at]) if len(at) else (), strict=True):
            out[i] = ids
        return out

    def _by_words(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids of the texts, put together from the distinct pieces of all of them: a word with
        the space before it, a line end, or one punctuation mark at the end of a word."""
        n = len(data)
        if n == 0:
            return [b""] * (len(off) - 1)
        ends = data == 10
        space = (data == 32) | ends
        start = space.copy()
        start[1:] |= ends[:-1]
        start[off[:-1][off[:-1] < n]] = True
        last = np.append(start[1:], True)  # the last byte of a piece
        start[1:] |= last[1:] & _IS_BEHIND[data[1:]] & _IS_ALNUM[data[:-1]]
        at = np.flatnonzero(start)
        bounds = pa.py_buffer(np.append(at, n).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, bounds, pa.py_buffer(data)])
        pieces = pieces.dictionary_encode()
        kind = pieces.indices.to_numpy()
        # Pieces are asked for in order of appearance; the memory learns those that it lacks.
        each = list(map(self.known.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        first = np.cumsum(size) - size
        n_ids = size[kind]
        done = np.cumsum(n_ids)
        ids = flat[np.repeat(first[kind] - done + n_ids, n_ids) + np.arange(done[-1])].tobytes()
        cut = 4 * np.append(0, done)[np.searchsorted(at, off)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _odd_space(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where white space stands that is not one space or line end between two words: next to
    another, at the end of a text, or a character other than these two."""
    space = (data == 32) | (data == 10)
    last = np.zeros(len(data), bool)
    last[off[1:][off[1:] > 0] - 1] = True
    odd = space & (last | np.append(space[1:], True))
    odd |= (data < 32) & (data != 10) | (data == 127)
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    a, b, c = (np.append(data, np.zeros(2, np.uint8))[lead + i] for i in range(3))
    wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    wide |= (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))
    wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8F) | (c >= 0xA8) & (c <= 0xAF)) | (b == 0x81) & (c == 0x9F))
    wide |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    odd[lead[wide]] = True
    return np.flatnonzero(odd)


_encoders: dict[str, Encoder] = {}


def _encoder(json: str) -> Encoder:
    key = hashlib.sha256(json.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(json)
    return _encoders[key]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes ``(doc_id, part, first, n_tokens, ids)`` of every row of ``docs`` (doc_id, text) as
    ORC below ``path``, in ascending order of doc_id over parts and rows (null first, rows of one
    id by text). ``tokenizer`` is the tokenizer's JSON; each text, null as an empty one, is
    encoded whole and ends with ``end_id``. A part is what one task writes, in one file or, under
    Spark's limit of records a file, several; ``first`` counts the ids before a row in its part."""
    json = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(json.value)
        number = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        done = 0
        for batch in batches:
            step = max(1, min(batch.num_rows, 1 + batch.num_rows * (4 << 20) // max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                ids = [x + end for x in encoder.encode(part.column(1))]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                first = done + np.concatenate([[0], np.cumsum(n)[:-1]])
                done += int(n.sum())
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.full(len(n), number, np.int32)),
                        pa.array(first),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(off), flat),
                    ],
                    ["doc_id", "part", "first", "n_tokens", "ids"],
                )
        encoder.before = {}  # the worker lives on

    ordered = plain(docs, doc_id="long", text="string").repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(freed(encode), _SCHEMA)
    encoded.write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, part, first, n_tokens, ids)``; filters on doc_id skip stripes and row groups."""
    return spark.read.schema(_SCHEMA).orc(path)


def describe_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files: start is the
    number of ids of all documents before it, the checksum that of its ids as read."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            off = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            raw = memoryview(np.ascontiguousarray(flat)).cast("B") if len(flat) else memoryview(b"")
            n = np.diff(off).astype(np.int64)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n), pa.array(crc, pa.int64())],
                ["part", "doc_id", "first", "n_tokens", "ids_crc32"],
            )

    tokens = read_tokens(spark, path)
    rows = tokens.select("part", "doc_id", "first", "ids")
    rows = rows.mapInArrow(freed(check), "part int, doc_id long, first long, n_tokens long, ids_crc32 long")
    parts = tokens.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if parts.count() <= PARTS_BROADCAST:
        parts = F.broadcast(parts)
    return rows.join(parts, "part").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and describes them as read. An
    empty table gives no files' rows; extra columns are ignored; repeated rows are written as
    often as they occur."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, Path(tokenizer_path).read_text(encoding="utf-8"), end_id)
    return describe_tokens(spark, path)
