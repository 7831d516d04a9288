"""The published example vectors, edge cases, and random strings against plain Python."""

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import twinstring as ts
from twinstring import cli
from twinstring.functions import cutoff_distance, deletion_variants, variant_count
from twinstring.sources import from_iterable, read_lines
from twinstring.streaming import stream_neighbors

QUERY = ["fizz", "fuzz", "buzz", "izzy", "lofi"]
REF = ["file", "tofu", "fizz"]
WITHIN = {1: [(0, 1, 1), (1, 2, 1)], 2: [(0, 1, 1), (0, 2, 2), (0, 3, 2), (1, 2, 1)]}
ACROSS = {
    1: [(0, 2, 0), (1, 2, 1)],
    2: [(0, 0, 2), (0, 2, 0), (1, 2, 1), (2, 2, 2), (3, 2, 2), (4, 1, 2)],
}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def brute_within(s, d):
    return [
        (i, j, lev(s[i], s[j]))
        for i in range(len(s))
        for j in range(i + 1, len(s))
        if lev(s[i], s[j]) <= d
    ]


def triples(got):
    assert [x.dtype for x in got] == [np.uint32, np.uint32, np.uint8]
    return list(zip(*(x.tolist() for x in got), strict=True))


@pytest.mark.parametrize("d", [1, 2])
def test_vectors(spark, d):
    assert triples(ts.get_neighbors_within(QUERY, d)) == WITHIN[d]
    assert triples(ts.get_neighbors_across(QUERY, REF, d)) == ACROSS[d]
    ref = ts.CachedRef(REF, 2)
    assert triples(ref.get_neighbors_across(QUERY, d)) == ACROSS[d]
    own = ts.CachedRef(QUERY, 2)
    assert triples(own.get_neighbors_within(d)) == WITHIN[d]
    assert triples(ref.get_neighbors_across(own, d)) == ACROSS[d]


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_random_strings(spark, d):
    rng = random.Random(d)
    s = ["".join(rng.choices("ab", k=rng.randrange(6))) for _ in range(60)]
    assert triples(ts.get_neighbors_within(s, d)) == brute_within(s, d)
    q, r = s[:25], s[25:]
    want = [(i, j, lev(a, b)) for i, a in enumerate(q) for j, b in enumerate(r) if lev(a, b) <= d]
    assert triples(ts.get_neighbors_across(q, r, d)) == want
    df = from_iterable(spark, s)
    plain = ts.neighbors_within(df, max_distance=d, validate=False, sort=True).collect()
    assert [tuple(x) for x in plain] == brute_within(s, d)


def test_empty_and_equal(spark):
    assert triples(ts.get_neighbors_within([], 1)) == []
    assert triples(ts.get_neighbors_within(["", "a", ""], 1)) == [(0, 1, 1), (0, 2, 0), (1, 2, 1)]
    assert len(triples(ts.get_neighbors_within(["x"] * 6, 2))) == 15
    assert triples(ts.get_neighbors_within(["ab", "b"], 9)) == [(0, 1, 1)]


def test_ids_and_extra_columns(spark):
    df = spark.createDataFrame(
        [(900, "abc", 1, "x"), (-4, "abd", 2, "y")], "id long, str string, row int, h string"
    )
    got = ts.neighbors_within(df).collect()
    assert [tuple(x) for x in got] == [(-4, 900, 1)]


def test_errors(spark):
    with pytest.raises(ValueError, match=r"non-ASCII input currently unsupported \('é' at 1\)"):
        ts.get_neighbors_within(["a", "é", "ü"])
    with pytest.raises(ValueError, match="capped at 254, got 255"):
        ts.get_neighbors_within(["a"], 255)
    with pytest.raises(OverflowError):
        ts.get_neighbors_within(["a"], -1)
    with pytest.raises(ValueError, match="expected iterable of str, got str"):
        ts.get_neighbors_within("abc")
    with pytest.raises(TypeError):
        ts.get_neighbors_within(["a", None])
    ref = ts.CachedRef(["a"], 1)
    with pytest.raises(ValueError, match="not compatible with max_distance above 1, got 2"):
        ref.get_neighbors_within(2)
    with pytest.raises(ValueError, match="expected iterable of str, got str"):
        ref.get_neighbors_across("abc")
    with pytest.raises(ValueError, match="query must be either"):
        ref.get_neighbors_across(5)
    with pytest.raises(ts.NullStringError):
        ts.neighbors_within(spark.createDataFrame([(1, None)], "id long, str string"))
    with pytest.raises(ts.VariantBudgetError):
        ts.CachedRef(["a" * 5000], 2)


@pytest.mark.parametrize("d", [1, 2, 3])
def test_long_strings(spark, d):
    rng = random.Random(d)
    strings = ["".join(rng.choices("abc", k=rng.choice([0, 1, 2, 5, 8, 9, 10, 11, 12, 30]))) for _ in range(40)]
    for s in strings[:20] * 2:
        s = list(s)
        for _ in range(rng.randrange(d + 2)):
            j = rng.randrange(len(s) + 1)
            s[j : j + rng.randrange(2)] = rng.choices("abc", k=rng.randrange(2))
        strings.append("".join(s))
    df = from_iterable(spark, strings)
    limit = {1: 1, 2: 60, 3: 200}[d]  # all strings pass it, or some
    got = ts.neighbors_within(df, max_distance=d, variant_limit=limit, sort=True).collect()
    assert [tuple(r) for r in got] == brute_within(strings, d)
    q, r = strings[:30], strings[30:]
    got = ts.neighbors_across(from_iterable(spark, q), from_iterable(spark, r), max_distance=d, variant_limit=limit, sort=True)
    want = [(i, j, lev(a, b)) for i, a in enumerate(q) for j, b in enumerate(r) if lev(a, b) <= d]
    assert [tuple(x) for x in got.collect()] == want
    text = "".join(rng.choices("abcdefgh", k=3000))
    assert triples(ts.get_neighbors_within([text, text[:1500] + text[1501:], text[::-1]], d)) == [(0, 1, 1)]


def test_functions(spark):
    df = spark.createDataFrame([("foo",), ("",)], "s string")
    rows = df.select(
        F.array_sort(deletion_variants(F.col("s"), 1)).alias("v"),
        variant_count(F.col("s"), 2).alias("n"),
        cutoff_distance(F.col("s"), F.lit("fo"), 1).alias("d"),
    ).collect()
    assert [tuple(r) for r in rows] == [(["fo", "foo", "oo"], 7.0, 1), ([""], 1.0, 255)]


def test_lines(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_bytes(b"a\r\nb\rc\n\nlast")
    got = read_lines(spark, str(f)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, "a"), (1, "b\rc"), (2, ""), (3, "last")]
    f.write_bytes(b"a\r\r\n\r\n\rb")
    got = read_lines(spark, str(f)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, "a\r"), (1, ""), (2, "\rb")]
    f.write_bytes(b"")
    assert read_lines(spark, str(f)).count() == 0


def test_lines_of_many_splits(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 50) for i in range(4000)]
    for k in range(3):
        text = "\n".join(lines[k * 1000 : (k + 1) * 1000 if k < 2 else 4000])
        (tmp_path / f"part-{k}.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        got = {r["id"]: r["str"] for r in read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(lines))


def test_repeats_are_joined_once(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=16))
    strings = [word()] * 300 + [word() for _ in range(600)]
    df = from_iterable(spark, strings)
    index = ts.NeighborIndex(df, max_distance=2)
    assert index.variants.count() <= 601 * (1 + 16 + 120)
    assert index.strings().count() == 900
    for pairs in (index.within(2), ts.neighbors_within(df, max_distance=2)):
        assert pairs.count() == 300 * 299 // 2
    own = index.across(index, max_distance=2).where("dist = 0")
    assert own.count() == 300 * 300 + 600
    index.unpersist()


def test_more_strings_than_positions(spark, monkeypatch):
    from twinstring.plans import checks

    monkeypatch.setattr(checks, "POSITIONS_WITHIN", 2)
    monkeypatch.setattr(checks, "POSITIONS_ACROSS", 1)
    with pytest.raises(ts.TooManyStringsError, match="query must not hold more than 2 elements, got 3"):
        ts.get_neighbors_within(["a", "b", "c"])
    with pytest.raises(ts.TooManyStringsError, match="reference must not hold more than 1 elements, got 2"):
        ts.get_neighbors_across(["a"], ["b", "c"])
    assert len(ts.get_neighbors_within(["a", "b"])[0]) == 1


def test_cli(spark, tmp_path, capsys):
    def run(*args, text="fizz\nfuzz\nbuzz"):
        out = io.StringIO()
        code = cli.main(list(args), io.StringIO(text), out, spark)
        return code, out.getvalue()

    assert run() == (0, "1,2,1\n2,3,1\n")
    assert run("-d", "2") == (0, "1,2,1\n1,3,2\n2,3,1\n")
    assert run("-d", "2", "-z") == (0, "0,1,1\n0,2,2\n1,2,1\n")
    q, r = tmp_path / "q", tmp_path / "r"
    q.write_text("fizz\nfuzz\nbuzz\n")
    r.write_text("fooo\nbarr\nbazz\nbuzz\n")
    assert run(str(q), str(r)) == (0, "2,4,1\n3,3,1\n3,4,0\n")
    assert run(text="ok\nバズ\n") == (1, "")
    assert "line 2" in capsys.readouterr().err
    assert run(str(tmp_path / "none"))[0] == 1


def test_index_table(spark):
    df = from_iterable(spark, QUERY)
    ts.NeighborIndex(df, max_distance=2, table="neighbour_index", buckets=4)
    index = ts.NeighborIndex.open(spark, "neighbour_index")
    assert index.max_distance == 2
    assert [tuple(x) for x in index.within(1, sort=True).collect()] == WITHIN[1]
    assert index.strings().count() == 5
    plan = index.within(1)._jdf.queryExecution().toString()
    assert plan.count("hashpartitioning(h") == 0
    spark.sql("DROP TABLE neighbour_index")


def test_stream(spark, tmp_path):
    from_iterable(spark, QUERY).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, str string").parquet(str(tmp_path / "in"))
    got = []
    index = ts.NeighborIndex(from_iterable(spark, REF), max_distance=2)
    q = stream_neighbors(
        stream, index, lambda df, _: got.extend(tuple(r) for r in df.collect()), max_distance=2
    )
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == ACROSS[2]


def test_deeper_index_reads_variants_of_the_distance(spark):
    df = from_iterable(spark, [f"name{i:04d}" for i in range(200)])
    index = ts.NeighborIndex(df, max_distance=2)
    shallow = ts.NeighborIndex(df, max_distance=1)
    assert index.upto(1).count() == shallow.variants.count() < index.variants.count()
    ts.NeighborIndex(df, max_distance=2, table="deep_index", buckets=4)
    table = ts.NeighborIndex.open(spark, "deep_index")
    assert table.upto(1).count() == shallow.variants.count()
    want = ts.neighbors_within(df, max_distance=1, sort=True).collect()
    assert want and index.within(1, sort=True).collect() == table.within(1, sort=True).collect() == want
    assert table.across(index, max_distance=1).count() == 200 + 2 * len(want)
    for name in ("deep_index", "deep_index_members"):
        spark.sql(f"DROP TABLE {name}")
    index.unpersist(), shallow.unpersist()


def test_rows_of_one_string_are_dealt_out(spark):
    # One string with thousands of rows, a near one with some, a third of one row.
    strings = ["abcd"] * 2500 + ["abce"] * 30 + ["abde"] + ["zzzzzz"]
    random.Random(1).shuffle(strings)
    df = from_iterable(spark, strings)
    at = {s: [i for i, t in enumerate(strings) if s == t] for s in set(strings)}
    met = [("abcd", "abcd", 0), ("abce", "abce", 0), ("abcd", "abce", 1), ("abce", "abde", 1)]
    want = np.array([(i, j, d) for a, b, d in met for i in at[a] for j in at[b] if a != b or i < j])
    want[:, :2].sort(axis=1)
    want = want[np.lexsort(want[:, 1::-1].T)]
    for pairs in (ts.neighbors_within(df), ts.NeighborIndex(df).within()):
        got = pairs.withColumn("task", F.spark_partition_id()).toPandas()
        assert got["task"].nunique() > 2
        assert (got["task"].value_counts() < 0.7 * len(got)).all()
        assert (got.sort_values(["row", "col"])[["row", "col", "dist"]].to_numpy() == want).all()
    assert ts.neighbors_within(df, max_distance=0).count() == (want[:, 2] == 0).sum()
    across = ts.neighbors_across(df, df).groupBy("dist").count().collect()
    assert {r["dist"]: r["count"] for r in across} == {0: 2500**2 + 30**2 + 2, 1: 2 * (want[:, 2] == 1).sum()}


def test_sentinels_of_one_nation_are_dealt_out(spark, tmp_path):
    from twinstring import catalog

    rows = spark.range(3000).select(
        F.col("id").alias("s_suppkey"), F.format_string("S%06d", "id").alias("s_name"), F.lit(7).alias("s_nationkey")
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalog.QUERIES["cutoff_distances"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    n = [r["count"] for r in got]
    assert sum(n) == 3000 * 2999 // 2 and max(n) < 0.7 * sum(n)


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_variant_frame(spark, d):
    from twinstring.operators.join import variant_frame

    rng = random.Random(d)
    strings = ["", "a", "aa", "aba", "abab", *("".join(rng.choices("ab", k=rng.randrange(9))) for _ in range(60))]
    want = set()
    for i, s in enumerate(strings):
        level = {s}
        for k in range(d + 1):
            want |= {(i, v, k) for v in level}
            level = {v[:p] + v[p + 1 :] for v in level for p in range(len(v))}
    hashed = spark.createDataFrame(sorted(want), "id long, v string, k int").select("id", F.xxhash64("v").alias("h"), "k")
    got = variant_frame(from_iterable(spark, strings), d).select("id", "h", "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, hashed.collect()))


def test_variants_of_two_deletions_are_no_arrays(spark):
    plan = ts.neighbors_within(from_iterable(spark, [*QUERY, "five5"]), max_distance=2)._jdf.queryExecution().toString()
    assert "array_distinct" not in plan
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and "levenshtein" in line]
    assert joins and all(line.index("(row#") < line.index("levenshtein") for line in joins)


def test_strings_of_one_length(spark):
    rng = random.Random(3)
    for n, letters in ((1, "abc"), (2, "ab"), (5, "ab"), (5, "0123")):
        strings = ["key" + "".join(rng.choices(letters, k=n)) for _ in range(150)]
        got = ts.neighbors_within(from_iterable(spark, strings), max_distance=2, sort=True)
        assert [tuple(r) for r in got.collect()] == brute_within(strings, 2)
    plan = got._jdf.queryExecution().toString()
    assert "(m#" in plan and "levenshtein(str" not in plan
