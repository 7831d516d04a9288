"""Exact deduplication by recipes of content-defined chunks. DataFrame operations only.

A text is cut where its own content says so, so that equal stretches of different texts become
equal chunks. A document is then the ordered list of its chunks' identifiers, its recipe, and
texts are equal where recipes are. Recipes, 8 bytes per kilobyte or so, are all that is moved:
the text of a chunk is read where it lies, hashed, and only identifiers that occur with more
than one content (hash collisions) would be told apart by a number of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinstring.llm.shared import plain, stash

#: A chunk ends after white space that follows one of these letters, or a line end, once it has
#: CHUNK_LEAST characters; at CHUNK_MOST it ends anyway. About one word in ten ends a chunk.
CUT_AFTER = "[nrdfbmgw.,]"
CHUNK_LEAST = 256
CHUNK_MOST = 4096


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, in order; their concatenation is the text. Null
    and empty texts have none."""
    # Reluctant and bounded: linear in the text, and no recursion on long ones.
    pattern = f"(?s).{{{CHUNK_LEAST},{CHUNK_MOST}}}?(?:(?<={CUT_AFTER})\\s|\\n)|.{{1,{CHUNK_MOST}}}"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)


def identifier(chunk: Column) -> Column:
    """Short name of a chunk, verified later."""
    return F.xxhash64(chunk)


def _verified(recipes: DataFrame) -> DataFrame:
    """Chunk identifiers ``key`` that stand for more than one content, each content with its
    ``rank``. A chunk is checked by its SHA-256; equal chunks are combined before anything is
    moved, and only identifiers of recipes that occur twice matter."""
    seen = recipes.select(F.explode("checks").alias("c")).select("c.key", "c.sha").distinct()
    clash = seen.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sort_array(F.collect_set("sha")).alias("shas"))
    return clash.where("m > 1").select("key", F.posexplode("shas").alias("rank", "sha"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Texts are equal if identical; null counts as empty. Of equal texts the largest doc_id
    stays; of rows that repeat a doc_id and its text, each is a row of the group, and all
    those of the largest id are marked kept. Null ids form groups too; a group of null ids only
    has a null keep_id and keeps all its rows. Extra columns are ignored; an empty table gives
    an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = plain(docs, doc_id="long", text="string").select(
        "doc_id", F.sha2(text, 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks")
    )
    rows = stash(
        cut.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "text_sha256",
            F.transform("chunks", lambda c: identifier(c)).alias("keys"),
            F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("shas"),
        ),
        "recipes",
    )
    same = rows.groupBy("keys").agg(F.count(F.lit(1)).alias("m"))
    twice = same.where((F.col("m") > 1) & (F.size("keys") > 0)).select("keys")
    # One content per recipe and task suffices: shas are combined before the shuffle.
    kinds = rows.groupBy("keys", "shas").agg(F.count(F.lit(1)).alias("m"))
    kinds = kinds.join(twice, "keys", "left_semi").select(
        F.arrays_zip(F.col("keys").alias("key"), F.col("shas").alias("sha")).alias("checks")
    )
    clash = stash(_verified(kinds), "clashes")
    if clash.isEmpty():
        recipes = rows.select("doc_id", "text_sha256", F.col("keys").alias("recipe"))
    else:
        ranked = (
            rows.select("row", "doc_id", "text_sha256", "keys", F.posexplode_outer("shas").alias("pos", "sha"))
            .withColumn("key", F.col("keys")[F.col("pos")])
            .join(clash, ["key", "sha"], "left")
        )
        part = F.struct("pos", "key", F.coalesce("rank", F.lit(0)).alias("rank"))
        recipes = ranked.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"), F.sort_array(F.collect_list(part)).alias("recipe")
        )
        recipes = stash(recipes.drop("row"), "recipes")
    groups = recipes.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # Written, so that a recipe of a third of all rows is a plain side of a join, which Spark splits.
    groups = stash(groups.where("group_size > 1"), "groups")
    return recipes.join(groups.hint("merge"), "recipe", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
