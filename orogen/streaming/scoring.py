"""Label a stream of points with a fitted model: a stateless projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from orogen.plans.clustering import Model


def label_stream(stream: DataFrame, model: Model, checkpoint: str, sink: str = "memory", name: str = "labels", **options) -> StreamingQuery:
    """Start a query that appends labelled points to ``sink``; ``checkpoint`` must be a shared folder."""
    writer = model.transform(stream).writeStream.format(sink).queryName(name).option("checkpointLocation", checkpoint)
    return writer.options(**options).outputMode("append").start()
