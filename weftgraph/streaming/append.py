"""Documents that arrive continuously, added to a stored model batch by batch."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftgraph.plans.index import index_documents
from weftgraph.sources.store import Store


def append_stream(documents: DataFrame, store: Store, llm: Any, embedder: Any, checkpoint: str, *, id_col: str = "doc_id", **options: Any) -> StreamingQuery:
    """Start a query that indexes each micro-batch of a streaming table into the store; it ends when all there is was read.

    The manifest notes the last batch, so that one which is replayed after a failure isn't added twice.
    """
    store.ensure()

    def add(batch: DataFrame, number: int) -> None:
        last = store.manifest().get("batch", -1)
        if number <= last or batch.isEmpty():
            return
        index_documents(store, batch.dropDuplicates([id_col]), llm, embedder, append=True, **options)
        store.note(batch=number)

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
