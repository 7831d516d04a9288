"""From raw documents to token files: five stages, each on all that the one before it kept.

Every function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``.

Null and empty texts are documents without words: never toxic, near copies of nothing, free of
benchmark items, taken once, and written as their end alone. Rows with a null doc_id stay until
the mix, which takes them as any others. Rows that repeat a doc_id share the verdict on its
toxicity and benchmark items; as near copies and in the mix each row counts for itself. Extra
columns are dropped; empty tables pass through as empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinstring.llm.decontaminate import decontaminate
from twinstring.llm.mixing import mixed_rows, word_count
from twinstring.llm.ngram_join import jaccard_components
from twinstring.llm.registry import tokenizer_path
from twinstring.llm.shared import shared_dir, stash
from twinstring.llm.token_orc import tokenize
from twinstring.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go, with all rows of their doc_id; rows with a
    null doc_id stay."""
    judged = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = judged.where("predicted = 1").select(F.col("doc_id").alias("toxic_id")).distinct()
    return docs.join(toxic, docs["doc_id"] == F.col("toxic_id"), "left_anti").select(COLUMNS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, the
    one with the least doc_id stays; of equal rows that repeat a doc_id, one."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        return _one_row_each(docs)
    classes = jaccard_components(docs, k=5, threshold=0.8)
    gone = classes.where("component_id <> doc_id").select(F.col("doc_id").alias("copy_id")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("copy_id"), "left_anti").select(COLUMNS)


def _one_row_each(docs: DataFrame) -> DataFrame:
    """The same where doc_ids repeat: rows are linked by ids of their own, and of the linked rows
    and of equal ones one stays. Rows without words are equal if their doc_id and text are."""
    rows = stash(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    own = F.when(F.col("doc_id").isNotNull(), F.col("row"))
    classes = jaccard_components(rows.select(own.alias("doc_id"), "text"), k=5, threshold=0.8)
    classes = classes.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    each = rows.select("row", "doc_id", F.sha2("text", 256).alias("sha")).join(classes, "row")
    empty = F.col("n_shingles") == 0
    group = [F.when(~empty, F.col("component_id")), F.when(empty, F.col("doc_id")), F.when(empty, F.col("sha"))]
    stays = each.groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)]).agg(F.min_by("row", F.struct("doc_id", "row")).alias("row"))
    gone = each.select("row").join(stays.select("row"), "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select(COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    # Rows of one id, source and size are alike to the mix; each gets one of their decisions.
    key = ["key_id", "no_id", "key_source", "no_source", "size"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(
            "*",
            F.coalesce("doc_id", F.lit(0)).alias("key_id"),
            F.col("doc_id").isNull().alias("no_id"),
            F.coalesce("source", F.lit("")).alias("key_source"),
            F.col("source").isNull().alias("no_source"),
        )

    dealt = keyed(mixed_rows(docs)).groupBy(*key).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("dealt"))
    dealt = dealt.where(F.col("dealt")[0] > 0)
    both = keyed(docs.select(*COLUMNS, word_count(F.col("text")).alias("size"))).join(dealt.hint("merge"), key)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text")))
    both = both.withColumn("copies", F.element_at("dealt", nth).cast("int")).where("copies > 0")
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return both.select(*COLUMNS, each.alias("copy")).select(COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ORC; a row per document written, as read back from them."""
    return tokenize(docs, tokenizer_path())


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_join", remove_near_copies),
    ("decontaminate", remove_benchmark),
    ("mixing", mix),
    ("token_orc", write_tokens),
]

#: The tokenizer's output is beyond SQL; tests/llm/test_pipeline.py holds the stages against plain
#: Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    raise ValueError("no stages")
