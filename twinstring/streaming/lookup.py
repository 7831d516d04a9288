"""Strings that arrive as a stream, matched against an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from twinstring.operators.index import NeighborIndex
from twinstring.plans.checks import check_distance


def stream_neighbors(
    stream: DataFrame,
    index: NeighborIndex,
    sink: Callable[[DataFrame, int], None],
    id_col: str = "id",
    str_col: str = "str",
    max_distance: int = 1,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Starts a query that gives ``sink(pairs, batch_id)`` the pairs of each micro-batch. No
    state outlives a batch: the index is static, and pairs are unique within their batch.
    Null strings match nothing."""
    check_distance(max_distance, index.max_distance)

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(index.across(batch, id_col, str_col, max_distance, validate=False), batch_id)

    writer = stream.writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
