"""Scoring a stream of examples against a fixed model: an extension, a stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.context import Context
from ..operators.prediction import predict


def score_stream(model: DataFrame, examples: DataFrame, context: Context, sink, *, strategy: str = "votingMajority", checkpoint: str | None = None, **trigger):
    """Starts a query that predicts each micro-batch of `examples` (row_id, intent) and hands it to sink(predictions, batch_id).

    Votes of an example never span batches, so each batch is a bounded prediction with no state.
    """

    def batch(rows: DataFrame, number: int) -> None:
        labelled = rows.withColumn("prop", context.labels.unknown())
        sink(predict(model, context.with_rows(labelled), strategy=strategy), number)

    writer = examples.writeStream.foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
