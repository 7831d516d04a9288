"""The driver's queries over the TPC-H-like tables, each with the SQL that must agree."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinstring import cli
from twinstring.errors import NeighborError
from twinstring.functions import (
    cutoff_distance,
    deletion_variants,
    is_ascii,
    variant_count,
)
from twinstring.local import CachedRef, Triple, get_neighbors_across, get_neighbors_within
from twinstring.operators.index import NeighborIndex
from twinstring.operators.join import neighbors_across, neighbors_within, own_pairs
from twinstring.sources.text import pair_lines, read_lines, write_pairs

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _within(table: str, key: str, text: str, d: int) -> Query:
    return lambda spark, sf: neighbors_within(_table(spark, sf, table), key, text, d)


def _within_sql(table: str, key: str, text: str, d: int) -> str:
    return (
        f"SELECT a.{key} AS row, b.{key} AS col,"
        f" CAST(levenshtein(a.{text}, b.{text}) AS INTEGER) AS dist"
        f" FROM {table} a JOIN {table} b ON a.{key} < b.{key}"
        f" WHERE levenshtein(a.{text}, b.{text}) <= {d}"
    )


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = _table(spark, sf, "customer")
    return c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1")


def _across(spark, sf):
    return neighbors_across(*_halves(spark, sf), "c_custkey", "c_name", 1)


def _across_cached(spark, sf):
    query, reference = _halves(spark, sf)
    index = NeighborIndex(reference, "c_custkey", "c_name", 2)
    return index.across(query, "c_custkey", "c_name", 1)


def _across_both_cached(spark, sf):
    query, reference = _halves(spark, sf)
    index = NeighborIndex(reference, "c_custkey", "c_name", 1)
    return index.across(NeighborIndex(query, "c_custkey", "c_name", 2), max_distance=1)


_ACROSS_SQL = (
    "SELECT a.c_custkey AS row, b.c_custkey AS col,"
    " CAST(levenshtein(a.c_name, b.c_name) AS INTEGER) AS dist"
    " FROM customer a JOIN customer b ON a.c_custkey % 2 = 0 AND b.c_custkey % 2 = 1"
    " WHERE levenshtein(a.c_name, b.c_name) <= 1"
)


def _brands(spark, sf):
    brands = (
        _table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    )
    return neighbors_across(brands, brands, "p_partkey", "p_brand", 1)


def _lines(zero_index: bool) -> Query:
    return lambda spark, sf: pair_lines(
        neighbors_within(_table(spark, sf, "supplier"), "s_suppkey", "s_name", 1), zero_index
    )


def _lines_sql(shift: int) -> str:
    return (
        f"SELECT concat(a.s_suppkey + {shift}, ',', b.s_suppkey + {shift}, ',',"
        " levenshtein(a.s_name, b.s_name)) AS line"
        " FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey"
        " WHERE levenshtein(a.s_name, b.s_name) <= 1"
    )


def _variants(spark, sf):
    return _table(spark, sf, "customer").select(
        "c_custkey", F.explode(deletion_variants(F.col("c_name"), 1)).alias("variant")
    )


def _counts(spark, sf):
    return _table(spark, sf, "part").select(
        "p_partkey", variant_count(F.col("p_name"), 2).cast("long").alias("variants")
    )


def _sentinels(spark, sf):
    """Nations are few: tasks share pairs of tiles of a nation's suppliers."""
    s = _table(spark, sf, "supplier").where("s_nationkey IS NOT NULL AND s_suppkey IS NOT NULL")
    pairs = own_pairs(s.select(F.col("s_nationkey").alias("rep"), F.struct("s_suppkey", "s_name").alias("id")))
    return pairs.select(
        F.least("x.s_suppkey", "y.s_suppkey").alias("row"),
        F.greatest("x.s_suppkey", "y.s_suppkey").alias("col"),
        cutoff_distance(F.col("x.s_name"), F.col("y.s_name"), 1).alias("dist"),
    ).where("row < col")


def _degrees(spark, sf):
    """Neighbours of each customer, none included: hits composed with ordinary aggregation."""
    c = _table(spark, sf, "customer")
    hits = neighbors_within(c, "c_custkey", "c_name", 1)
    ends = hits.select(F.explode(F.array("row", "col")).alias("c_custkey"))
    n = ends.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))
    return (
        c.select("c_custkey")
        .join(n, "c_custkey", "left")
        .select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("neighbours"))
    )


def _ascii(spark, sf):
    return _table(spark, sf, "documents").select(
        "doc_id", is_ascii(F.col("text")).alias("ascii")
    )


def _index_within(depth: int, d: int) -> Query:
    return lambda spark, sf: NeighborIndex(
        _table(spark, sf, "customer"), "c_custkey", "c_name", depth
    ).within(d)


def _index_repeats(spark, sf):
    return NeighborIndex(_table(spark, sf, "part"), "p_partkey", "p_name", 1).within(1)


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one where Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='twinstring-')}"
    return f"{base.rstrip('/')}/text-{uuid.uuid4().hex}"


def _line_file(spark: SparkSession, sf: str, where: str = "true", end: str = "\n") -> str:
    """The suppliers' names in order of their keys, as one text file."""
    path = _folder(spark)
    names = _table(spark, sf, "supplier").where(where).orderBy("s_suppkey").select("s_name")
    names.coalesce(1).write.option("lineSep", end).text(path)
    return path


def _text_lines(spark, sf):
    return read_lines(spark, _line_file(spark, sf, end="\r\n"))


def _names(spark: SparkSession, sf: str) -> list[str]:
    return [r["s_name"] for r in _table(spark, sf, "supplier").orderBy("s_suppkey").select("s_name").collect()]


def _frame(spark: SparkSession, got: Triple) -> DataFrame:
    rows = list(zip(*(x.tolist() for x in got), strict=True))
    return spark.createDataFrame(rows, "row long, col long, dist int")


def _cli(*sources: str | None, zero_index: bool = False) -> Query:
    """The lines that the command line prints for files of suppliers (conditions), or for standard
    input (None)."""

    def run(spark, sf):
        stdin = io.StringIO("".join(f"{n}\n" for n in _names(spark, sf)))
        files = [_line_file(spark, sf, s) for s in sources if s]
        out = io.StringIO()
        if cli.main([*(["-z"] if zero_index else []), *files], stdin, out, spark):
            raise RuntimeError("the command line failed")
        return spark.createDataFrame([(line,) for line in out.getvalue().splitlines()], "line string")

    return run


def _written(spark, sf):
    pairs = neighbors_within(_table(spark, sf, "supplier"), "s_suppkey", "s_name", 1)
    path = _folder(spark)
    write_pairs(pairs, path, zero_index=True)
    return spark.read.text(path).withColumnRenamed("value", "line")


def _local_cached(spark, sf):
    return _frame(spark, CachedRef(_names(spark, sf), 2, spark=spark).get_neighbors_within(1))


def _local_cached_across(query_cached: bool) -> Query:
    def run(spark, sf):
        names = _names(spark, sf)
        query = CachedRef(names[::2], 1, spark=spark) if query_cached else iter(names[::2])
        return _frame(spark, CachedRef(names[1::2], 2, spark=spark).get_neighbors_across(query, 1))

    return run


def _refusals(spark, sf):
    """What is raised for inputs out of bounds."""
    tries = {
        "cap": lambda: get_neighbors_within(["a"], 255, spark=spark),
        "cache": lambda: CachedRef(["a"], 1, spark=spark).get_neighbors_within(2),
        "ascii": lambda: get_neighbors_within(["a", "\u00e9"], 1, spark=spark),
        "string": lambda: get_neighbors_within("abc", 1, spark=spark),
    }
    rows = []
    for name, one in tries.items():
        try:
            one()
        except (NeighborError, ValueError) as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "input string, message string")


_POSITIONS = "WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_name AS s FROM supplier)"
_POSITIONS_WITHIN = (
    f"{_POSITIONS} SELECT a.i AS row, b.i AS col, CAST(levenshtein(a.s, b.s) AS INTEGER) AS dist"
    " FROM s a JOIN s b ON a.i < b.i WHERE levenshtein(a.s, b.s) <= 1"
)
_POSITIONS_ACROSS = (
    f"{_POSITIONS} SELECT a.i // 2 AS row, b.i // 2 AS col, CAST(levenshtein(a.s, b.s) AS INTEGER) AS dist"
    " FROM s a JOIN s b ON a.i % 2 = 0 AND b.i % 2 = 1 WHERE levenshtein(a.s, b.s) <= 1"
)

QUERIES: dict[str, Query] = {
    "within_d1_customer": _within("customer", "c_custkey", "c_name", 1),
    "within_d2_customer": _within("customer", "c_custkey", "c_name", 2),
    "within_d0_part": _within("part", "p_partkey", "p_name", 0),
    "within_d1_part": _within("part", "p_partkey", "p_name", 1),
    "within_d2_url": _within("pages", "page_id", "url", 2),
    "across_d1_customer": _across,
    "across_d1_brand": _brands,
    "index_within_d1": _index_within(1, 1),
    "index_within_depth2_d1": _index_within(2, 1),
    "index_across_d1": _across_cached,
    "index_across_index_d1": _across_both_cached,
    "cli_lines_one_based": _lines(False),
    "cli_lines_zero_based": _lines(True),
    "deletion_variants_d1": _variants,
    "variant_counts_d2": _counts,
    "cutoff_distances": _sentinels,
    "neighbour_counts": _degrees,
    "ascii_audit": _ascii,
    "index_within_repeats": _index_repeats,
    "text_lines": _text_lines,
    "text_sink": _written,
    "cli_one_file": _cli("true"),
    "cli_two_files": _cli("s_suppkey % 2 = 1", "s_suppkey % 2 = 0", zero_index=True),
    "cli_stdin": _cli(None),
    "local_within": lambda spark, sf: _frame(spark, get_neighbors_within(iter(_names(spark, sf)), 1, spark=spark)),
    "local_across": lambda spark, sf: _frame(
        spark, get_neighbors_across(_names(spark, sf)[::2], _names(spark, sf)[1::2], 1, spark=spark)
    ),
    "local_cached_within": _local_cached,
    "local_cached_across": _local_cached_across(False),
    "local_cached_across_cached": _local_cached_across(True),
    "hit_count": lambda spark, sf: neighbors_within(_table(spark, sf, "customer"), "c_custkey", "c_name", 1).agg(
        F.count(F.lit(1)).alias("hits")
    ),
    "refusals": _refusals,
}

ORACLES: dict[str, str] = {
    "within_d1_customer": _within_sql("customer", "c_custkey", "c_name", 1),
    "within_d2_customer": _within_sql("customer", "c_custkey", "c_name", 2),
    "within_d0_part": _within_sql("part", "p_partkey", "p_name", 0),
    "within_d1_part": _within_sql("part", "p_partkey", "p_name", 1),
    "within_d2_url": _within_sql("pages", "page_id", "url", 2),
    "across_d1_customer": _ACROSS_SQL,
    "across_d1_brand": (
        "WITH b AS (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY p_brand)"
        " SELECT x.k AS row, y.k AS col,"
        " CAST(levenshtein(x.p_brand, y.p_brand) AS INTEGER) AS dist"
        " FROM b x CROSS JOIN b y WHERE levenshtein(x.p_brand, y.p_brand) <= 1"
    ),
    "index_within_d1": _within_sql("customer", "c_custkey", "c_name", 1),
    "index_within_depth2_d1": _within_sql("customer", "c_custkey", "c_name", 1),
    "index_across_d1": _ACROSS_SQL,
    "index_across_index_d1": _ACROSS_SQL,
    "cli_lines_one_based": _lines_sql(1),
    "cli_lines_zero_based": _lines_sql(0),
    "deletion_variants_d1": (
        "SELECT c_custkey, c_name AS variant FROM customer"
        " UNION SELECT c_custkey, substr(c_name, 1, i - 1) || substr(c_name, i + 1)"
        " FROM (SELECT c_custkey, c_name, unnest(range(1, length(c_name) + 1)) AS i FROM customer)"
    ),
    "variant_counts_d2": (
        "SELECT p_partkey, CAST(1 + length(p_name) + length(p_name) * (length(p_name) - 1) // 2"
        " AS BIGINT) AS variants FROM part"
    ),
    "cutoff_distances": (
        "SELECT a.s_suppkey AS row, b.s_suppkey AS col,"
        " CAST(CASE WHEN levenshtein(a.s_name, b.s_name) <= 1"
        " THEN levenshtein(a.s_name, b.s_name) ELSE 255 END AS INTEGER) AS dist"
        " FROM supplier a JOIN supplier b"
        " ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"
    ),
    "neighbour_counts": (
        "SELECT c.c_custkey, count(b.c_custkey) AS neighbours FROM customer c"
        " LEFT JOIN customer b ON c.c_custkey <> b.c_custkey"
        " AND levenshtein(c.c_name, b.c_name) <= 1 GROUP BY c.c_custkey"
    ),
    "ascii_audit": "SELECT doc_id, strlen(text) = length(text) AS ascii FROM documents",
    "index_within_repeats": _within_sql("part", "p_partkey", "p_name", 1),
    "text_lines": f"{_POSITIONS} SELECT i AS id, s AS str FROM s",
    "text_sink": _lines_sql(0),
    "cli_one_file": (
        f"{_POSITIONS} SELECT concat(a.i + 1, ',', b.i + 1, ',', levenshtein(a.s, b.s)) AS line"
        " FROM s a JOIN s b ON a.i < b.i WHERE levenshtein(a.s, b.s) <= 1"
    ),
    "cli_two_files": (
        "WITH s AS (SELECT s_suppkey % 2 AS side, s_name AS s, row_number() OVER"
        " (PARTITION BY s_suppkey % 2 ORDER BY s_suppkey) - 1 AS i FROM supplier)"
        " SELECT concat(a.i, ',', b.i, ',', levenshtein(a.s, b.s)) AS line"
        " FROM s a JOIN s b ON a.side = 1 AND b.side = 0 WHERE levenshtein(a.s, b.s) <= 1"
    ),
    "cli_stdin": (
        f"{_POSITIONS} SELECT concat(a.i + 1, ',', b.i + 1, ',', levenshtein(a.s, b.s)) AS line"
        " FROM s a JOIN s b ON a.i < b.i WHERE levenshtein(a.s, b.s) <= 1"
    ),
    "local_within": _POSITIONS_WITHIN,
    "local_across": _POSITIONS_ACROSS,
    "local_cached_within": _POSITIONS_WITHIN,
    "local_cached_across": _POSITIONS_ACROSS,
    "local_cached_across_cached": _POSITIONS_ACROSS,
    "hit_count": (
        "SELECT count(*) AS hits FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey"
        " AND levenshtein(a.c_name, b.c_name) <= 1"
    ),
    "refusals": (
        "SELECT * FROM (VALUES ('cap', 'max_distance is capped at 254, got 255'),"
        " ('cache', 'CachedRef instance not compatible with max_distance above 1, got 2'),"
        " ('ascii', 'non-ASCII input currently unsupported (''\u00e9'' at 1)'),"
        " ('string', 'expected iterable of str, got str')) AS t(input, message)"
    ),
}
