"""Impact of a stream of changes: every micro-batch is judged against one graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .. import work
from ..operators.graph import Graph
from ..operators.impact import compute, uncertain_closure


def impact_stream(changes: DataFrame, graph: Graph, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that gives ``sink`` the impact of each micro-batch and its number, again under the same number after a failure.

    A change set must lie in one micro-batch. The closure of unresolved imports is taken once, at the start; the graph's tables should be
    checkpointed or read from a table, as each batch reads them again. ``trigger`` is for ``DataStreamWriter.trigger``.
    """
    uncertain = work.checkpoint(uncertain_closure(graph))

    def batch(rows: DataFrame, number: int) -> None:
        held = rows.persist()
        try:
            if not held.isEmpty():
                sink(compute(graph, held, uncertain=uncertain), number)
        finally:
            held.unpersist()

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
