"""Search of a static index for a stream of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import VectorIndex


def search_stream(index: VectorIndex, queries: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Each micro-batch of ``queries`` (qid, qvec) is searched as one block; ``sink`` gets its result and number.

    Ranking needs all of a query's scores, which a stream's windows cannot hold; a micro-batch can. The
    sink sees a batch again after a failure, under the same number.
    """
    index.fit()

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(index.search(batch, k), number)

    writer = queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
