"""The batch bookkeeping behind a stream of summary rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from roiscore.operators.summary import upserted


def upsert_stream(rows: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, order: list[str]) -> StreamingQuery:
    """Every micro-batch of summary rows replaces the rows of its slides; what is there by now runs through and the query ends.

    read gives the summary as it stands, write stores the next one under the batch's number (never over the one being read).
    """
    query = rows.writeStream.foreachBatch(lambda batch, number: write(upserted(read(), batch, order), number))
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
