"""Language identification in two levels: family, then pairs of languages inside it.

Texts are vectors of hashed byte 1- to 4-grams, counted over the whole text, square-rooted and
scaled to length one. A linear support vector machine per family picks the family; inside it
one-versus-one machines vote. Everything is trained on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinstring.llm.shared import crc_mod, freed, plain, stash
from twinstring.llm.words import BLOCK_BYTES, LOWER, lists, text_column

#: Labelled documents per language that are trained on at most, those of least hash; and of all
#: languages, with FIT_LEAST of each at least.
FIT_ROWS = 400
FIT_ALL = 8_000
FIT_LEAST = 20
#: Languages whose counts may be broadcast; checked by a count.
LANGUAGES_BROADCAST = 10_000
DIMENSIONS = 1 << 13
ORDERS = 4
UNKNOWN = "und"

#: Families of common language codes; a code not listed is its own family.
FAMILIES = {
    "germanic": "en de nl af da sv no nb nn is fy lb yi",
    "romance": "fr es pt it ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi bn ur pa gu mr ne",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")
_FOLD = LOWER.copy()
_FOLD[:128] = [c if chr(c).isalpha() else 32 for c in LOWER[:128]]


def family(language: str) -> str:
    return FAMILY.get(language.split("-")[0].lower(), language)


def vectors(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """Unit vectors of the rows, in order, one at a time. Runs of anything but letters count
    as one space; n-grams lie inside the text with a space at either end."""
    data, off = text_column(batch, name)
    mult = np.uint32(2654435761)
    for lo, hi in zip(off[:-1], off[1:], strict=True):
        counts = np.zeros(DIMENSIONS)
        for at in range(lo, hi, BLOCK_BYTES):  # a long text in pieces that overlap by an n-gram
            b = _FOLD[data[max(lo, at - ORDERS + 1) : min(hi, at + BLOCK_BYTES)]]
            old = min(at - lo, ORDERS - 1)
            b = np.concatenate([b if at > lo else np.append(np.uint8(32), b), [np.uint8(32)] if at + BLOCK_BYTES >= hi else []]).astype(np.uint32)
            run = np.ones(len(b), bool)
            run[1:] = (b[1:] != 32) | (b[:-1] != 32)
            skip = int(run[: old if at > lo else 0].sum())
            b = b[run]
            code = np.zeros(len(b), np.uint32)
            for n in range(ORDERS):
                code = code[: len(b) - n] * np.uint32(257) + b[n:] + np.uint32(1)
                if len(code) == 0:
                    break
                # n-grams that end in the overlap were counted with the piece before
                mine = code[max(0, skip - n) :]
                slot = ((mine ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * mult) >> np.uint32(19)
                counts += np.bincount(slot, minlength=DIMENSIONS)
        x = np.sqrt(counts)
        yield x / max(1e-9, float(np.sqrt(x @ x)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 4.0, rounds: int = 60) -> np.ndarray:
    """Linear machine with squared hinge loss by dual coordinate descent; the last coefficient
    is the bias. ``weight``: cost of each row."""
    rng = np.random.default_rng(0)
    n = len(x)
    xb = np.concatenate([x, np.ones((n, 1), x.dtype)], axis=1)
    w = np.zeros(xb.shape[1])
    alpha = np.zeros(n)
    soft = 1 / (2 * c * weight)
    q = np.einsum("ij,ij->i", xb, xb) + soft
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            g = y[i] * (xb[i] @ w) - 1 + soft[i] * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * xb[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w.astype(np.float32)


def _binary(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    y = np.where(positive, 1.0, -1.0)
    share = positive.mean()
    return _svm(x, y, np.where(positive, 0.5 / share, 0.5 / (1 - share)))


class Model:
    """Machines as rows of one matrix, so that a document costs one product."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        self.languages = sorted(set(languages))
        lang = np.array(languages, object)
        fam = np.array([family(s) for s in languages], object)
        self.families = sorted(set(fam))
        rows = []
        self.pairs: list[tuple[int, int]] = []
        if len(self.families) > 1:
            rows += [_binary(x, fam == f) for f in self.families]
        self.members = {f: [s for s in self.languages if family(s) == f] for f in self.families}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                some = (lang == a) | (lang == b)
                self.pairs.append((self.languages.index(a), self.languages.index(b)))
                rows.append(_binary(x[some], lang[some] == a))
        self.weights = np.stack(rows) if rows else np.zeros((0, DIMENSIONS + 1), np.float32)

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        if not self.languages:
            return UNKNOWN, 0.0
        s = self.weights[:, :-1] @ v + self.weights[:, -1]
        sure = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
        confidence = 1.0
        best = self.families[0]
        if len(self.families) > 1:
            k = int(np.argmax(s[: len(self.families)]))
            best = self.families[k]
            confidence = sure(s[k])
            s = s[len(self.families) :]
        votes = dict.fromkeys(self.members[best], 0.0)
        margin = dict.fromkeys(self.members[best], 0.0)
        least: dict[str, float] = {}
        for (a, b), m in zip(self.pairs, s, strict=True):
            p, q = self.languages[a], self.languages[b]
            if p in votes:
                for one, sign in ((p, 1), (q, -1)):
                    votes[one] += sign * m > 0
                    margin[one] += sign * m
                    least[one] = min(least.get(one, 30.0), sign * m)
        top = max(votes, key=lambda k: (votes[k], margin[k], k))
        return top, float(confidence * sure(least.get(top, 30.0)))


def _sparse(docs: DataFrame) -> DataFrame:
    """``(lang, slots, values)`` of the sampled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = [], []
            for v in vectors(batch, "text"):
                at = np.flatnonzero(v)
                slots.append(at.astype(np.int32))
                values.append(v[at].astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(slots, pa.int32()), lists(values, pa.float32())],
                ["lang", "slots", "values"],
            )

    return docs.select("lang", "text").mapInArrow(
        freed(run), "lang string, slots array<int>, values array<float>"
    )


def fit(docs: DataFrame) -> Model:
    """Model of ``docs`` (doc_id, text, lang): rows outside the held-out fold with a language
    and a letter, at most FIT_ROWS of each language. Rows that share a doc_id (null is one too)
    and a language count as one, with the least text."""
    usable = docs.where(
        F.col("lang").isNotNull()
        & F.coalesce(crc_mod(F.col("doc_id"), 3) != 1, F.lit(True))
        & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    )
    # Ids are thinned by hash to some more than are wanted before they are ranked, so that a
    # language of a third of all rows is counted in every task but never gathered.
    ids = usable.select(F.col("doc_id").alias("id"), F.col("lang").alias("l")).distinct()
    ids = stash(ids.select("id", "l", F.xxhash64("id").alias("h")), "fit-ids")
    counts = ids.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    languages = counts.count()
    want = max(FIT_LEAST, min(FIT_ROWS, FIT_ALL // max(1, languages)))
    share = F.least(F.lit(1.0), F.lit(2.0 * want + 100) / F.col("n"))
    counts = counts.select("l", (share * float(1 << 63)).alias("most"))
    if languages <= LANGUAGES_BROADCAST:  # else ids would be dealt by language before they are thinned
        counts = F.broadcast(counts)
    first = Window.partitionBy("l").orderBy("h", "id")
    ids = ids.join(counts, "l").where(F.abs(F.col("h").cast("double")) <= F.col("most"))
    ids = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= want).select("id", "l")
    ids = stash(ids, "fit-ids")
    small = F.broadcast(ids) if ids.count() <= 100_000 else ids
    sample = usable.join(small, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("l")), "left_semi")
    sample = sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = _sparse(sample).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], len(r["slots"]), r["slots"][:8], r["values"][:8]))
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, r in enumerate(rows):
        x[i, r["slots"]] = r["values"]
    return Model(x, [r["lang"] for r in rows])


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of ``docs`` (doc_id, text, lang).

    Texts without a letter, null and empty ones included, are ``und`` with score 0, and so are
    all where no row can be learnt from. A language's only family member needs no second
    level. Rows that repeat are predicted each; rows of a null id are trained on and not held
    out. Extra columns are ignored. An empty table gives an empty result.
    """
    d = plain(docs, doc_id="long", text="string", lang="string")
    model = fit(d)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_column(batch, "text")
            langs, scores = [], []
            for i, v in enumerate(vectors(batch, "text")):
                raw = data[off[i] : off[i + 1]]
                letters = (_FOLD[raw] != 32) & (raw < 128)
                if letters.any() or (len(raw) and _LETTER.search(raw.tobytes().decode("utf-8", "replace"))):
                    lang, score = shared.value.predict(v)
                else:
                    lang, score = UNKNOWN, 0.0
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    out = d.select("doc_id", "text").mapInArrow(freed(run), "doc_id long, lang_pred string, score double")
    return out.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
