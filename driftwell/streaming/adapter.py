"""Feeding base tables from streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from driftwell.engine import Engine


def capture(engine: Engine, table: str, stream: DataFrame, checkpoint: str, views: Iterable[str] = (), query: str = "capture", once: bool = True) -> StreamingQuery:
    """Append every micro-batch of *stream* (rows, or changes with _w) to *table*'s log, then refresh *views*.

    The log remembers the last batch of *query*, so a batch repeated after a failure changes nothing: with the stream's own
    checkpoint that makes capture exactly-once. *once* takes what is there now and stops.
    """
    names = list(views)

    def batch(df: DataFrame, number: int) -> None:
        engine.apply(table, df, batch=(query, number))
        for name in names:
            engine.refresh(name)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(query)
    return (writer.trigger(availableNow=True) if once else writer).start()
