"""The ten operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pyarrow import orc
from tokenizers import Tokenizer
from twinstring.llm import brown_lm, decontaminate, exact_dedup, html_text, mixing, ngram_join, registry, toxicity, url_filter
from twinstring.llm.exact_dedup import chunks, exact_copies
from twinstring.llm.language_id import identify
from twinstring.llm.ngram_join import jaccard_components
from twinstring.llm.shared import hand_back
from twinstring.llm.token_orc import Encoder, read_tokens, tokenize, write_tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_driver_hands_memory_back(spark):
    """The join's rounds end what their plans hold on the driver: garbage is collected after each
    part of a round, and the JVM has the command that gives its allocator's memory back."""
    assert "Trim native heap" in hand_back(spark)
    jvm = spark._jvm
    collectors = jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    # Only full collections; those of young objects happen anyway.
    full = lambda: sum(c.getCollectionCount() for c in collectors if "Old" in c.getName() or "MarkSweep" in c.getName())
    rows = spark.createDataFrame([(i, f"one two three four five w{i % 3}") for i in range(9)], "doc_id long, text string")
    before = full()
    assert {r["component_id"] for r in jaccard_components(rows, pivot_rounds=1).collect()} == {0, 1, 2}
    assert full() - before >= 6


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard(docs, corpus, k, num, den):
    sets = {}
    for i, t, *_ in corpus:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = by_id(jaccard_components(docs, k, num / den))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {
        i: (len(s), find(i)) for i, s in sets.items()
    }


@pytest.mark.parametrize("many_pairs", [ngram_join.MANY_PAIRS, 0])
def test_jaccard_links_of_a_groups_other_classes(spark, monkeypatch, many_pairs):
    """Of three texts, two share size and prefix, so that they are one group, but are too far apart
    to link (94 of 106 words); the third is near both (97 of 104) and in no group with them."""
    monkeypatch.setattr(ngram_join, "MANY_PAIRS", many_pairs)
    rng = random.Random(5)
    usual = [f"c{j}" for j in range(40)]
    texts, want = [], []
    for c in range(12):
        own = [f"u{c}_{j}" for j in range(94)]
        some = rng.sample(usual, 12)
        three = [own + some[:6], own + some[6:], own + some[3:9] + [f"x{c}"]]
        want += [len(texts)] * 3
        texts += [three[(c + j) % 3] for j in range(3)]  # each comes first in a third of them
    for i in range(60):  # makes usual words frequent, so that they are in no prefix
        want.append(len(texts))
        texts.append(rng.sample(usual, 30) + [f"f{i}_{j}" for j in range(70)])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = by_id(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 0.9))
    assert [got[i]["component_id"] for i in range(len(rows))] == want


def test_exact(docs, corpus):
    groups = {}
    for i, t, *_ in corpus:
        groups.setdefault(t or "", []).append(i)
    got = by_id(exact_copies(docs))
    for i, t, *_ in corpus:
        g = groups[t or ""]
        sha = hashlib.sha256((t or "").encode()).hexdigest()
        assert tuple(got[i]) == (i, max(g), len(g), i == max(g), sha)


@pytest.mark.parametrize("name", [lambda c: F.lit(7).cast("long"), lambda c: F.length(c).cast("long")])
def test_exact_with_colliding_identifiers(docs, corpus, name, monkeypatch):
    monkeypatch.setattr(exact_dedup, "identifier", name)
    both = docs.unionByName(docs.where("doc_id % 2 = 0")).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    got = Counter(map(tuple, exact_copies(both).collect()))
    monkeypatch.undo()
    assert got == Counter(map(tuple, exact_copies(both).collect()))
    rows = [(i, t or "") for i, t in both.select("doc_id", "text").collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    assert got == Counter((i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)


def test_chunks_are_the_text(docs, corpus):
    rows = docs.select("text", F.concat_ws("", chunks(F.col("text"))).alias("again")).collect()
    assert all((r["text"] or "") == r["again"] for r in rows)


def test_mix(docs, corpus):
    got = by_id(mixing.mix_sources(docs))
    size = Counter()
    for i, t, _, s in corpus:
        assert got[i]["size"] == len(WORD.findall(t or ""))
        assert got[i]["taken"] in {0, got[i]["size"], 2 * got[i]["size"]}
        size[s] += got[i]["size"]
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[j % 3] for j, s in enumerate(order)}
    capped = set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        level = rest / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and weight[s] * level > 2 * size[s]}
        if not new:
            break
        capped |= new
    for i, _, _, s in corpus:
        want = 2.0 * size[s] if s in capped else weight[s] * level
        assert got[i]["target"] == pytest.approx(want)
        assert got[i]["source_size"] == size[s]
    again = by_id(mixing.mix_sources(docs.repartition(5)))
    assert all(again[i]["taken"] == r["taken"] for i, r in got.items())
    taken, expected, rates, longest = Counter(), Counter(), {}, Counter()
    for i, _, _, s in corpus:
        r = got[i]
        taken[s] += r["taken"]
        expected[s] += r["rate"] * r["size"]
        longest[s] = max(longest[s], r["size"])
        rates.setdefault(s, {})[r["size"]] = r["rate"]
    tilts = 0
    for s in order:
        want = 2.0 * size[s] if s in capped else weight[s] * level
        assert expected[s] == pytest.approx(want, rel=2e-6)  # the dual's gradient
        assert abs(taken[s] - want) <= longest[s]
        # one multiplier a source: log(rate) / size is the same wherever the bound doesn't hold
        x = [np.log(r) / z for z, r in rates[s].items() if z > 3 and 0 < r < 2 and abs(np.log(r)) > 1e-3]
        tilts += len({round(r, 6) for r in rates[s].values()}) > 2
        assert not x or max(x) - min(x) <= 1e-5 + 0.01 * abs(min(x, key=abs))
    assert tilts


def test_mix_of_repeated_rows(spark):
    rows = [(7, "a b c", "s")] * 25_000 + [(None, "a b", "s")] * 30 + [(i, "w " * (i % 9), None) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_sources(d)
    assert got.count() == len(rows)
    n = got.where("doc_id = 7").agg(F.sum("copies"), F.min("copies"), F.max("copies"), F.first("rate")).first()
    assert abs(n[0] - 25_000 * n[3]) <= 2
    assert n[2] - n[1] <= 1


def test_tokens_round_trip(spark, docs, corpus, tmp_path):
    path = registry.tokenizer_path()
    t = Tokenizer.from_file(path)
    want, start = {}, 0
    for i, text, *_ in sorted(corpus, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = by_id(tokenize(docs, path))
    assert {i: tuple(r)[1:] for i, r in got.items()} == want
    out = f"file://{tmp_path}/t"
    write_tokens(docs, out, open(path, encoding="utf-8").read())
    one = read_tokens(spark, out).where("doc_id = 9").collect()
    assert len(one) == 1
    assert one[0]["n_tokens"] == want[9][1]


def test_encoder_on_odd_white_space():
    enc = Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    rng = random.Random(5)
    bits = ["a", "B", " ", " ", "  ", "\n", "\t", ".", "!!", "é", "1", "'s", "'", "\u00a0", "日本", "\r\n", "the", "’", "<|endoftext|>"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(3000)]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode(texts) == want
    assert enc.encode(["<|endoftext|>"]) == [np.array([50256], "<u4").tobytes()]


def test_starts_over_several_files_a_task(spark, docs, corpus):
    path = registry.tokenizer_path()
    want = {r["doc_id"]: r["start"] for r in tokenize(docs, path).collect()}
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        assert {r["doc_id"]: r["start"] for r in tokenize(docs, path).collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def scanned(df):
    """Rows that the scan of a plan gave up, after what it skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_token_files_are_pruned(spark, tmp_path):
    out = f"file://{tmp_path}/t"
    d = spark.range(0, 24_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    write_tokens(d.repartition(3), out, open(registry.tokenizer_path(), encoding="utf-8").read())
    everything = read_tokens(spark, out)
    assert scanned(everything.select("n_tokens")) == 12_000
    some = everything.select("doc_id", "n_tokens")
    assert 1 <= scanned(some.where("doc_id = 8000")) <= 1000  # row index
    assert scanned(some.where("doc_id = 8001")) <= 1000  # no such id: Bloom filter, but for its errors
    absent = [scanned(some.where(f"doc_id = {i}")) for i in range(5001, 5021, 2)]
    assert sum(n == 0 for n in absent) >= 7
    assert scanned(some.where("doc_id = 900000")) == 0
    files = [orc.ORCFile(f) for f in tmp_path.glob("t/*.orc")]
    assert sum(f.nrows for f in files) == 12_000
    assert all(f.row_index_stride == 1000 and f.nstripes >= 1 for f in files)
    raw = sum(f.content_length for f in files)
    assert raw < 12_000 * 4 * everything.agg(F.avg("n_tokens")).first()[0]  # run lengths: under 4 bytes an id


def best_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_with_edits_are_found(spark):
    rng = random.Random(1)
    text = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    items = [text(n) for n in (3, 6, 15, 25, 40, 59) for _ in range(3)]
    rows, words = [], {}
    for item in items:
        for kind in ("none", "substitute", "insert", "delete", "mixed", "mixed"):
            w = list(item)
            for _ in range(decontaminate.budget(len(w)) if kind != "none" else 0):
                one = rng.choice(["substitute", "insert", "delete"]) if kind == "mixed" else kind
                j = rng.randrange(len(w))
                if one == "substitute":
                    w[j] = text(1)[0]
                elif one == "insert":
                    w[j:j] = text(1)
                else:
                    del w[j]
            words[len(rows)] = text(rng.randrange(30)) + w + text(30)
            rows.append((len(rows), " ".join(words[len(rows)])))
    for _ in range(30):
        words[len(rows)] = text(120)
        rows.append((len(rows), " ".join(words[len(rows)])))
    rows += [(9001, None), (9002, ""), (None, " ".join(items[9])), (5, rows[5][1])]
    bench = [(j, ", ".join(w).upper()) for j, w in enumerate(items)] + [(98, None), (99, "  "), (100, " ".join(text(5000)))]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, item_id int, h string")
    b = spark.createDataFrame([(j, t, 1, 2) for j, t in bench], "item_id long, text string, doc_id int, distance int")
    hits = [(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.benchmark_hits(d, b).collect()]
    want = {(i, j, best_distance(x, w)) for i, w in words.items() for j, x in enumerate(items)}
    want = {(i, j, n) for i, j, n in want if n <= decontaminate.budget(len(items[j]))}
    assert sum(i is None for i, _, _ in hits) >= 1
    found = {h for h in hits if h[0] is not None}
    assert {h[:2] for h in found} <= {h[:2] for h in want}
    exact = {h for h in want if h[2] == 0}
    assert exact <= found
    full = {h for h in want if len(items[h[1]]) > 5}
    assert len(found & full) >= 0.9 * len(full)
    assert sum(h[0] == 5 for h in hits) == 2 * sum(h[0] == 5 for h in found)
    gone = {h[0] for h in found}
    assert decontaminate.decontaminate(d, b).count() == len(rows) - len(gone) - (5 in gone)


def test_very_long_and_repetitive_texts(spark):
    item = [f"q{i}" for i in range(40)]
    long = ["the"] * 9_000 + [f"x{i}" for i in range(30_000)]
    long[30_000:30_000] = item
    rows = [(1, " ".join(long)), (2, "the " * 9_000), (3, " ".join(item[:20] * 2000))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item)), (2, "the " * 30)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.benchmark_hits(d, b).collect()}
    assert got == {(1, 1), (1, 2), (2, 2)}


def test_a_later_partial_copy_hides_no_passage(spark):
    rng = random.Random(6)
    text = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    items = [text(30) for _ in range(60)]
    rows = []
    for j, item in enumerate(items):
        k = decontaminate.budget(len(item))
        leak, decoy = list(item), list(item)
        for at in rng.sample(range(len(item)), k):
            leak[at] = "zz"
        for at in rng.sample(range(len(item)), k + 2):
            decoy[at] = "yy"
        left, gap = text(20) + leak, text(150)
        rows += [(2 * j, " ".join(left + gap + text(30))), (2 * j + 1, " ".join(left + gap + decoy))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.benchmark_hits(d, b).collect()}
    alone = {j for j in range(len(items)) if (2 * j, j) in got}
    assert len(alone) >= 0.95 * len(items)
    assert {j for j in alone if got.get((2 * j + 1, j)) == got[2 * j, j]} == alone


def test_short_and_unspaced_items_are_found(spark):
    rows = [(1, "x y Alpha, beta z"), (2, "alpha z beta"), (3, "昨日は猫が魚を食べたので困りました。"), (4, "犬が骨"), (5, "an Apple pie"), (6, "昨日は猫が肉を食べたので"), (7, None), (8, "")]
    items = [(10, "alpha BETA"), (11, "猫が魚を食べた"), (12, "apple"), (13, ""), (14, "..."), (15, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"], r["n_words"], r["end_word"]) for r in decontaminate.benchmark_hits(d, b).collect()}
    # what has no edit is always found, (6, 11) with one by the recall of the repetitions
    assert got - {(6, 11, 1, 7, 10)} == {(1, 10, 0, 2, 4), (3, 11, 0, 7, 10), (5, 12, 0, 1, 2)}


def test_pipeline_stages_on_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    a, b = text(), text()
    rows = [(1, a, "s0"), (1, a, "s0"), (1, b, "s0"), (2, a, "s0"), (3, b, "s0"), (4, "", "s1"), (4, "", "s1"), (5, "", "s1"), (None, a, None), (None, a, None)]
    wide = lambda rows: spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.remove_near_copies(spark, wide(rows), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, a), (1, b), (4, ""), (5, ""), (0, a), (0, a)])
    rows = [(j % 7 if j % 3 else None, text(), f"s{j % 4}" if j % 5 else None) for j in range(60)] + [(1, a, "s1")] * 6
    mixed = wide(rows)
    want = Counter()
    for r in mixing.mix_sources(mixed).collect():
        want[r["doc_id"]] += r["copies"]
    out = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix(spark, mixed, "").collect())
    got = Counter()
    for (i, _), n in out.items():
        got[i] += n
    assert got == +want
    assert all(n <= (12 if t == a else 2) for (_, t), n in out.items())


def all_segments(x):
    """Maximal-scoring segments by their definition: the best one, then those on either side."""
    spans = [(sum(x[i:j]), i - j, -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
    if not spans or max(spans)[0] <= 0:
        return []
    best, _, _, i, j = max(spans)
    return [*all_segments(x[:i]), best, *all_segments(x[j:])]


def test_segments():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.choice([-3, -1, 1, 2, 4]) for _ in range(rng.randrange(1, 15))]
        assert sorted(toxicity.segments(np.array(x))) == sorted(all_segments(x))
    falling = np.tile([1.0, -2.0], 200_000)  # no candidate ever joins another
    began = time.process_time()
    assert len(toxicity.segments(falling)) == 200_000
    assert time.process_time() - began < 20  # a quadratic scan takes hours


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        w = [f"n{int(rng.paretovariate(0.7)) % 5000}" for _ in range(rng.randrange(5, 120))]
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["slurone", "slurtwo", "vile" + rng.choice("abcdefgh")]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(5000, ""), (5001, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = by_id(toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")))
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.98
    assert got[5000]["predicted"] == got[5001]["predicted"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>a="</p>"</script></head>
<body><header>Site</header><nav><a>Menu</a></nav><div class="cookie-notice">OK?</div>
<article><h1>A &amp; B</h1><p><b>First
   line<br>more<p>Second<aside>Also</aside><div class=ad>Buy</div>{inline}</article>
<div id="comments"><article>Reader</article></div><footer>&copy;</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE.replace("{inline}", "")) == "A & B\nFirst line more\nSecond"
    assert html_text.main_text("") == ""
    assert html_text.main_text("plain <b>text</b> 1 < 2") == "plain text 1 < 2"
    assert html_text.main_text("<p>a<!-- x --><p>b<script>c") == "a\nb"
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"


def test_no_article_is_lost():
    page = html_text.main_text
    assert page('<div class="layout has-sidebar"><article><p>One two three</p></article></div>') == "One two three"
    assert page('<p data-id="search">a b</p><p data-role="comment">c</p>') == "a b\nc"
    assert page("<main><h1>T</h1><p>Long story here</p><article>teaser</article></main>") == "T\nLong story here\nteaser"
    assert page("<form><h1>Head</h1><p>All in one form, as some sites do</p></form>") == "Head\nAll in one form, as some sites do"
    assert page("<div><p>No article element</p></div><nav>Menu</nav>") == "No article element"
    assert page(None or "") == ""


def test_site_template_goes(spark):
    rows = [(i, f"http://h.org/{i}", PAGE.replace("{inline}", f"<p>Own {i}</p><p>Read our great terms</p>")) for i in range(12)]
    rows += [(50, "http://other.org/1", PAGE.replace("{inline}", "<p>Read our great terms</p>")), (51, None, None), (52, "x", "")]
    # Neither names nor article elements: only counts can tell.
    plain = lambda i, tail: (
        f'<div class="x1"><a>Go {i}</a><a>There {i}</a></div><div class="x2">{"word " * (20 + i)}<p>Story {i} ends</p></div>'
        f'<div class="x3">Fresh {i} news</div>{tail}'
    )
    rows += [(100 + i, f"http://plain.org/{i}", plain(i, "")) for i in range(40)]
    rows += [(200, "http://plain.org/x", plain(200, '<div class="x9">Once only</div>')), (0, "http://h.org/0", rows[0][2])]
    # A section of a host; copies of one article; a page whose main part is shorter than its menu.
    rows += [(300 + i, f"http://plain.org/s/{i}", plain(i, f'<div class="x7">Section box {i}</div>')) for i in range(12)]
    rows += [(400 + i, f"http://copies.org/{i}", plain(7, "")) for i in range(12)]
    rows += [(500, "http://plain.org/short", '<div class="x1"><a>Go on and on and on</a></div><div class="x2">Short<p>Tale</p></div>')]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, hashes int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    story = lambda i: ("word " * (20 + i)).strip() + f"\nStory {i} ends"
    assert len(got) == len(rows) - 1
    assert "terms" not in got[3][0]
    assert got[3][0].endswith("Own 3")
    assert got[50][0].endswith("terms")
    assert got[51] == got[52] == ("", 0)
    assert {got[100 + i][0] == story(i) for i in range(40)} == {True}
    assert got[200][0] == story(200) + "\nOnce only"
    assert {got[300 + i][0] == story(i) for i in range(12)} == {True}
    assert {got[400 + i][0] == story(7) for i in range(12)} == {True}
    assert got[500] == ("Short\nTale", 10)


def test_numbers_in_names(spark):
    """Boxes whose classes differ by a number are of two kinds, with text of their own or nested;
    a page's number on what holds the main part hides no template."""
    page = lambda i, tail: f'<body class="post-{i}"><div class="x1">Go {i}</div><div class="x2">{"word " * 40}<p>Tale {i}</p></div>{tail}</body>'
    box = lambda c, t: f'<div class="x{c}">{t}<p>{t}</p></div>'
    rows = [(i, f"http://h.org/{i}", page(i, box(7, f"Box {i}"))) for i in range(20)]
    rows += [(20, "http://h.org/20", page(20, box(9, "Once"))), (21, "http://h.org/21", page(21, '<div class="x9"><p>Nested</p></div>'))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    story = lambda i: ("word " * 40).strip() + f"\nTale {i}"
    assert got == {i: story(i) for i in range(20)} | {20: story(20) + "\nOnce\nOnce", 21: story(21) + "\nNested"}


def test_template_hashes_are_those_of_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("host", html_text.host_of(F.col("url")))
    seen, total = Counter(), Counter()
    for r in pages.select("host", "html").collect():
        total[r["host"]] += 1
        seen.update((r["host"], *x) for x in html_text.subtree_hashes(r["html"]))
    want = {h: set() for h, n in total.items() if n >= 10}
    for (h, x, kind), n in seen.items():
        beside = kind == html_text.ASIDE and n >= 10 and n >= 3 * seen[h, x, html_text.ON_WAY]
        if h in want and (beside or (kind == html_text.INSIDE and n >= max(10, total[h] / 2))):
            want[h].add(x)
    got = {r["host"]: set(r["hashes"]) for r in html_text.templates(pages).collect()}
    assert got == want
    assert sum(map(len, got.values())) > 0
    texts = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    rows = [r for r in pages.collect() if r["host"] in want]
    off = {r["page_id"]: html_text.main_text(r["html"], frozenset(), True) for r in rows}
    assert sum(texts[i] != t for i, t in off.items()) > 0.9 * len(off)
    for r in rows:
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        assert texts[r["page_id"]] == html_text.main_text(f"<article>{article}</article>")


def test_url_rules(spark):
    urls = ["HTTP://A.Example.ORG/es/x", "http://example.org/en/12?q#f", "http://example.org/en/2", "http://org", "x://myorg/", "ftp://u.com/de/", "no", None, "a://b.com/fr/?x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [tuple(r)[1:] for r in url_filter.judge_urls(pages, registry.URL_RULES).orderBy("page_id").collect()]
    assert got == [
        ("a.example.org", "/es/x", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/en/2", "org/", "allow"),
        ("org", "", None, "allow"),
        ("myorg", "/", None, "allow"),
        ("u.com", "/de/", "com/de/", "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("b.com", "/fr/", "com/fr/", "allow"),
    ]


def test_urls_against_every_rule(spark):
    rng = random.Random(3)
    rules = [(rng.choice(["allow", "block"]), ".".join(rng.choices("ab", k=rng.randrange(4))), "/" + "".join(rng.choices("xy/", k=rng.randrange(5)))) for _ in range(60)]
    urls = ["://".join(["h", ".".join(rng.choices("ab", k=rng.randrange(1, 5))) + "/" + "".join(rng.choices("xy/", k=rng.randrange(6)))]) for _ in range(400)]
    rows = [(i, u, "x", 1) for i, u in enumerate([*urls, None, ""])]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host int")
    for r in url_filter.judge_urls(pages, rules).collect():
        fit = [(len(h.split(".")) if h else 0, len(p), v == "block", h + p, v) for v, h, p in rules
               if (not h or r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        best = max(fit, default=(0, 0, False, None, "allow"))
        assert (r["rule"], r["verdict"]) == best[3:]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_language_model(docs, corpus):
    tok = {i: [*WORD.findall(lower(t)), "\0"] for i, t, *_ in corpus}
    count = Counter()
    for i, w in tok.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(w)
    n, v = sum(count.values()), len(count)
    got = by_id(brown_lm.score(docs))
    for i, w in tok.items():
        base = sum(np.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] <= 0


def test_rare_words_have_classes_of_their_own(spark):
    rng = random.Random(8)
    word = lambda kind: f"{kind}{rng.randrange(4000)}end"
    texts = [" ".join(word("ab"[j % 2]) for j in range(100)) for _ in range(1500)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = brown_lm.score(d).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (r[0] - r[1]) / r[2] > 0.25  # two kinds in turn: log10(2) = 0.30 at best


def test_best_class_is_that_of_brute_force():
    rng = np.random.default_rng(9)
    f = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()
    for _ in range(30):
        pairs = rng.integers(0, 9, (12, 12)) * (rng.random((12, 12)) < 0.6)
        np.fill_diagonal(pairs, 0)
        cls = rng.integers(0, 4, 12)
        one = np.eye(4)[cls]
        near = np.concatenate([pairs.T @ one, pairs @ one], axis=1)
        word, cell = np.nonzero(near)
        if len(np.unique(word)) < 12:
            continue
        got = brown_lm.best_classes(one.T @ pairs @ one, cls, word, cell, near[word, cell])
        for u in range(12):
            each = []
            for d in range(4):
                o = np.eye(4)[np.where(np.arange(12) == u, d, cls)]
                a = o.T @ pairs @ o
                each.append(f(a) - f(a.sum(0)) - f(a.sum(1)))
            assert each[got[u]] == pytest.approx(max(each))


def test_languages_and_classes_beat_chance(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    # rows of a null id teach as one a language, repeated ones and ties as one
    some = docs.where("lang IS NOT NULL AND length(text) > 200")
    null = some.withColumn("doc_id", F.lit(None).cast("long"))
    again = identify(null.unionByName(null).withColumn("l", F.lit("x")).withColumn("id", F.lit(2)))
    langs = {r["lang"] for r in some.select("lang").distinct().collect()}
    assert {r["lang_pred"] for r in again.select("lang_pred").distinct().collect()} <= langs
    assert again.where("held_out").count() == 0
    r = brown_lm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_no_rows_and_no_labels(spark, no_docs, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert jaccard_components(no_docs).count() == 0
    assert exact_copies(no_docs).count() == 0
    assert mixing.mix_sources(no_docs).count() == 0
    assert tokenize(no_docs, registry.tokenizer_path()).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_hits(docs, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench).count() == docs.count()
    assert toxicity.toxicity(docs, labels).count() == docs.count()
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert brown_lm.score(no_docs).count() == 0
    assert identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


ODD = "doc_id long, text string, lang string, source string, size int, score string, row long, id long, part int, toxic int, comp string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, ties, a text of 60,000 words, and columns named like the operators'."""
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(700)}" for _ in range(n))
    rows = [(i, text(30), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(120)]
    rows += [(5, rows[5][1], "en", "s1")] * 2 + [(7, text(20), None, None)] + [(None, t, "de", None) for t in ("", None, rows[9][1], rows[9][1])]
    rows += [(300, text(60_000), "en", "s0"), (301, " ", None, "s0"), (302, "12 34 !", "en", None), (303, "x" * 90_000, "fr", "s2")]
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, "y") for r in rows], ODD).repartition(3).cache()


def odd_labels(spark):
    rows = [(i, int(i % 10 == 0)) for i in range(120)] + [(None, 1), (5, None), (5, 1), (20, 0)]
    return spark.createDataFrame([(*r, "text", 0.5) for r in rows], "doc_id long, toxic int, text string, score double")


OPERATORS = {
    "tokens": lambda d: tokenize(d, registry.tokenizer_path()).drop("start"),
    "mixing": mixing.mix_sources,
    "toxicity": lambda d: toxicity.toxicity(d, odd_labels(d.sparkSession)),
    "jaccard": jaccard_components,
    "language_model": brown_lm.score,
    "exact": exact_copies,
    "language": identify,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd, name):
    got = OPERATORS[name](odd).collect()
    want = Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert Counter(r["doc_id"] for r in got) == want
    for r in got:
        assert all(v is not None for k, v in r.asDict().items() if k not in ("doc_id", "keep_id", "component_id"))
    if name not in ("mixing",):  # there, rows that are alike share copies
        same = [tuple(r) for r in got if r["doc_id"] == 5]
        assert len(same) == 3
        assert len(set(same)) == 1
    if name == "jaccard":
        assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}
        assert next(r["n_shingles"] for r in got if r["doc_id"] == 300) == 59_996
    if name == "language":
        assert {r["lang_pred"] for r in got if r["doc_id"] in (301, 302)} == {"und"}


def test_empty_pages_and_documents(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_text.extract(pages).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f", 2)], "item_id long, text string, doc_id int")
    assert decontaminate.benchmark_hits(docs, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench).count() == 0
