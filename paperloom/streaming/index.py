"""New papers into a vector store as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.functions import vectors as V
from paperloom.sources.files import append_index


def index_stream(papers: DataFrame, store: str, checkpoint: str, dim: int = 64) -> StreamingQuery:
    """papers(id, text), streaming -> ``store``, to be read by ``sources.files.current``.

    Every batch is a version of the store: a paper that comes again replaces its vector, a batch that runs again changes nothing,
    and no batch reads what is there already.
    """

    def add(batch: DataFrame, number: int) -> None:
        append_index(batch.select("id", V.hashed(F.col("text"), dim).alias("embedding")), store, dim, number)

    return papers.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
