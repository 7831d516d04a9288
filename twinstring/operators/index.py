"""A reference collection expanded once and queried many times."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinstring.operators.join import (
    expand,
    in_order,
    members,
    most_rows,
    representatives,
    spread,
    variant_frame,
    verified_pairs,
    within_variants,
)
from twinstring.plans.checks import VARIANT_LIMIT, check_distance, check_strings, normalise


class NeighborIndex:
    """Variant frame of the distinct strings of ``df`` for distances up to ``max_distance``,
    hash-partitioned by the variant so that no query shuffles it again, and the rows of strings
    that repeat. A query for a smaller distance sees variants of as many deletions only: those of
    more find nothing that these do not, but most candidates.

    With ``table`` the frame is written as a table bucketed by the variant hash, and the rows as
    ``{table}_members``, which other sessions open with :meth:`open` and whose loss of an
    executor costs nothing; without, both are persisted on memory and disk, the frame once for each
    distance that is asked for.
    """

    def __init__(
        self,
        df: DataFrame,
        id_col: str = "id",
        str_col: str = "str",
        max_distance: int = 1,
        *,
        table: str | None = None,
        buckets: int | None = None,
        validate: bool = True,
        variant_limit: int = VARIANT_LIMIT,
    ):
        self.max_distance, self._most = check_distance(max_distance), None
        frame = normalise(df, id_col, str_col)
        if validate:
            check_strings(frame, max_distance, "reference", variant_limit, refuse=True)
        else:
            frame = frame.dropna()
        self.spark = df.sparkSession
        parts = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        reps = representatives(frame)
        same = members(frame, reps)
        self.table = table
        self._reps, self._parts, self._frames = spread(reps), parts, {}
        if table:
            variants = variant_frame(self._reps, max_distance)
            (
                variants.repartition(parts, "h")
                .write.mode("overwrite")
                .bucketBy(parts, "h")
                .sortBy("h")
                .option("max_distance", str(max_distance))
                .saveAsTable(table)
            )
            self.spark.sql(
                f"ALTER TABLE {table} SET TBLPROPERTIES ('max_distance' = '{max_distance}')"
            )
            same.write.mode("overwrite").saveAsTable(f"{table}_members")
            self.members = self.spark.table(f"{table}_members")
        else:
            self.members = same.persist(StorageLevel.MEMORY_AND_DISK)

    @classmethod
    def open(cls, spark, table: str) -> NeighborIndex:
        self = cls.__new__(cls)
        self.spark, self.table, self._most = spark, table, None
        self.members = spark.table(f"{table}_members")
        props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
        self.max_distance = int(props["max_distance"])
        return self

    @property
    def variants(self) -> DataFrame:
        return self.upto(self.max_distance)

    def upto(self, max_distance: int) -> DataFrame:
        """``(h, id, str, k)`` of the variants by at most ``max_distance`` deletions."""
        if self.table:
            frame = self.spark.table(self.table)
            # Tables of earlier versions don't tell the number of deletions.
            return frame.where(F.col("k") <= max_distance) if "k" in frame.columns else frame
        if max_distance not in self._frames:
            frame = variant_frame(self._reps, max_distance).repartition(self._parts, "h")
            self._frames[max_distance] = frame.persist(StorageLevel.MEMORY_AND_DISK)
        return self._frames[max_distance]

    def most(self) -> int:
        """Rows of the most frequent string, 0 where none repeats."""
        if self._most is None:
            self._most = most_rows(self.members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")))
        return self._most

    def within(self, max_distance: int = 1, *, sort: bool = False) -> DataFrame:
        """As ``neighbors_within`` on the indexed strings."""
        check_distance(max_distance, self.max_distance)
        return in_order(within_variants(self.upto(max_distance), self.members, max_distance, self.most()), sort)

    def across(
        self,
        query: DataFrame | NeighborIndex,
        id_col: str = "id",
        str_col: str = "str",
        max_distance: int = 1,
        *,
        sort: bool = False,
        validate: bool = True,
    ) -> DataFrame:
        """Pairs of a query row (``row``) and an indexed row (``col``)."""
        check_distance(max_distance, self.max_distance)
        if isinstance(query, NeighborIndex):
            check_distance(max_distance, query.max_distance)
            left, same, most = query.upto(max_distance), query.members, query.most()
        else:
            frame = normalise(query, id_col, str_col)
            if validate:
                check_strings(frame, max_distance, "query", refuse=True)
            else:
                frame = frame.dropna()
            reps = representatives(frame)
            left, same = variant_frame(spread(reps), max_distance), members(frame, reps)
            most = most_rows(reps)
        pairs = verified_pairs(left, self.upto(max_distance), max_distance, ordered=False)
        return in_order(expand(pairs, same, self.members, max(most, self.most())), sort)

    def strings(self) -> DataFrame:
        """``(id, str)`` of all indexed rows."""
        reps = self.upto(0).where(F.col("h") == F.xxhash64("str")).select(F.col("id").alias("rep"), "str").distinct()
        return reps.join(self.members, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "str")

    def unpersist(self) -> None:
        if not self.table:
            for frame in self._frames.values():
                frame.unpersist()
            self.members.unpersist()
