"""What the operators share: written intermediate tables, id filters, components, text joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of long ids that may be broadcast (about 16 MB as a hash relation); checked by a count.
BROADCAST_IDS = 500_000
#: Rows of a batch that goes to Python: some megabytes of documents, twice per task.
BATCH_ROWS = 1000
#: Bytes of such a batch at about most; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where none is configured and Spark runs
    in one process, as in tests, a local one is made."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='twinstring-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back. This cuts the lineage and, unlike
    a cache, outlives every executor."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    hand_back(df.sparkSession)
    return out


def discard(stashed: DataFrame) -> None:
    """Deletes what ``stash`` wrote. Nothing that is still to be computed may read it."""
    spark = stashed.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stashed.stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hand_back(spark: SparkSession) -> str:
    """What ``freed`` does, for the driver: many plans leave its JVM's allocator with a hundred MB
    and more that it keeps. Takes milliseconds. Gives the JVM's report, or nothing where it has no
    such command."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    find = jvm.java.lang.Class.forName
    # The server's own class is closed to reflection, its interface is not.
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    signature, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    try:
        for i, kind in enumerate(kinds):
            signature[i] = find(kind)
        values[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        values[1] = "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return find("javax.management.MBeanServer").getMethod("invoke", signature).invoke(server, values) or ""
    except Py4JError:
        return ""


def collect_garbage(spark: SparkSession) -> None:
    """Ends what finished plans hold: Spark deletes shuffles and broadcasts only when the driver's
    JVM collects what refers to them, and its heap grows by plans until then."""
    spark._jvm.System.gc()
    hand_back(spark)


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast: ``plain(docs, doc_id="long", text="string")``. Other
    columns, whatever they are called, can clash with nothing afterwards. Every operator
    starts here, so this also keeps the session's Arrow batches of documents small: Spark reads
    both limits from the session when a plan runs, so they can't be set for a plan alone. Smaller
    limits of the session stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.select(*[df[c].cast(t).alias(c) for c, t in columns.items()])


Batches = Iterator[pa.RecordBatch]


def freed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow that hands its memory back to the system when its task ends. The
    worker lives on, and what its allocators keep would count beside the next stage's."""

    def each(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):  # glibc has it
                libc.malloc_trim(0)

    return each


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``: the fold of a document."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % n


def keep_ids(df: DataFrame, ids: DataFrame, column: str, n_ids: int) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids``. Few ids are sent to the rows, so that long
    texts of other rows are not shuffled; many are joined."""
    side = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
    return df.join(side, column, "left_semi")


def with_both_texts(pairs: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``pairs`` (a, b, ...) with ``text_a`` and ``text_b``. Only texts of ids that occur in a
    pair are moved."""
    ids = stash(
        pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids"
    )
    some = keep_ids(docs.select("doc_id", text), ids, "doc_id", ids.count())
    a = some.select(F.col("doc_id").alias("a"), F.col(text).alias("text_a"))
    b = some.select(F.col("doc_id").alias("b"), F.col(text).alias("text_b"))
    return pairs.join(a, "a").join(b, "b")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.unionByName(back)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(id, root)`` of every vertex of ``edges`` (a, b): root is the least id it can reach.

    Alternating large-star and small-star steps; each is two aggregations and a join over the
    remaining edges, written out between rounds. Edges never reach the driver: it sees a count
    and a checksum. An empty input gives an empty result.
    """
    e = stash(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        near = _both_ways(e)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        own = least.select("u", F.col("m").alias("v"))
        last, e = e, stash(linked.unionByName(own).distinct(), "edges")
        discard(last)
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    roots = own.select(F.col("root").alias("id"), "root").distinct()
    return own.unionByName(roots)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)
