"""The five stages, each held against plain Python on its own input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from twinstring.llm import decontaminate, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near_groups(rows):
    """Least id that links of similarity 0.8 lead to."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def corpus():
    rng = random.Random(21)
    word = lambda: f"n{int(rng.paretovariate(0.6)) % 4000}"
    text = lambda n: [word() for _ in range(n)]
    items = [text(n) for n in (12, 20, 35)]
    rows, kind, labels = [], {}, []

    def add(words, what):
        i = len(rows)
        kind[i] = what
        t = " ".join(words) if words is not None else None
        rows.append((i, t, rng.choice(["en", None]), rng.choice(["s0", "s1", "s2", None]), len(t or "")))
        return words

    for i in range(500):
        w = text(rng.randrange(20, 60))
        toxic = i % 5 == 0
        for _ in range(4 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["slurone", "slurtwo", "vileword"]))
        add(w, "toxic" if toxic else "clean")
        labels.append((i, 1, int(toxic)))
    for _ in range(6):
        base = add(text(60), "clean")
        add(base, "copy")
        near = list(base)
        near[30] = "changed"
        add(near, "copy")
    for item in items:
        add(text(20) + item + text(15), "leak")
    add([], "clean")
    add(None, "clean")
    return rows, labels, items, kind


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    rows, labels, items, kind = corpus()
    base = f"file://{tmp_path_factory.mktemp('pipeline')}"
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    bench = [(j, " ".join(w)) for j, w in enumerate(items)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    seen = []

    def watched(name, stage):
        def each(spark, docs, sf_dir):
            seen.append(docs)
            return stage(spark, docs, sf_dir)

        return name, each

    kept = corpus_pipeline.STAGES
    corpus_pipeline.STAGES = [watched(*s) for s in kept]
    try:
        out = corpus_pipeline.run(spark, base).collect()
    finally:
        corpus_pipeline.STAGES = kept
    tables = [[tuple(r) for r in d.select("doc_id", "text", "source").collect()] for d in seen]
    assert all(d.columns == corpus_pipeline.COLUMNS for d in seen)
    return tables, out, items, kind


def test_toxic_documents_go(ran):
    (before, after, *_), _, _, kind = ran
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert len(after) == len(before) - len(gone)
    toxic = {i for i, k in kind.items() if k == "toxic"}
    assert len(gone & toxic) >= 0.95 * len(toxic)
    assert not {i for i in gone if kind[i] in ("copy", "leak")}
    assert len(gone - toxic) <= 2


def test_one_of_each_group_of_near_copies_stays(ran):
    (_, before, after, *_), *_ = ran
    group = near_groups([r[:2] for r in before])
    assert sorted(r[0] for r in after) == sorted(set(group.values()))
    assert sum(i != g for i, g in group.items()) >= 12


def test_leaks_go(ran):
    (_, _, before, after, _), _, items, kind = ran
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert gone == {r[0] for r in before if kind[r[0]] == "leak"}
    assert len(items) == len(gone)
    assert decontaminate.budget(35) == 7


def test_sources_meet_their_targets(ran):
    (_, _, _, before, after), *_ = ran
    size = lambda t: len(WORD.findall(t or ""))
    total, taken, longest = Counter(), Counter(), Counter()
    for _, t, s in before:
        total[s] += size(t)
        longest[s] = max(longest[s], size(t))
    for _, t, s in after:
        taken[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[j % 3] for j, s in enumerate(order)}
    capped = set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        level = rest / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and weight[s] * level > 2 * total[s]}
        if not new:
            break
        capped |= new
    for s in order:
        assert abs(taken[s] - (2 * total[s] if s in capped else weight[s] * level)) <= longest[s]
    times = Counter(r[:2] for r in after)
    assert set(times) <= {r[:2] for r in before}
    assert max(times.values()) <= 2


def test_token_rows(ran):
    (*_, before), out, _, _ = ran
    t = Tokenizer.from_file(registry.tokenizer_path())
    rows = sorted(before, key=lambda r: (r[0], r[1] or ""))
    want, start = [], 0
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in out) == sorted(want)


def test_no_documents(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.createDataFrame([], COLUMNS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    assert corpus_pipeline.run(spark, base).count() == 0
    odd = [(None, None, None, None, None), (None, "a b c", None, None, 5), (1, "", "en", "s", 0)]
    spark.createDataFrame(odd, COLUMNS).write.mode("overwrite").parquet(f"{base}/documents.parquet")
    got = corpus_pipeline.run(spark, base)
    assert got.where(F.col("n_tokens") > 0).count() == got.count() >= 1
