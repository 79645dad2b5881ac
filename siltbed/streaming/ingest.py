"""Streams of changes into a store, batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltbed.sources.files import Folder
from siltbed.store import Store


def ingest(changes: DataFrame, store: Store, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Writes each micro-batch of (key, value, deleted) rows to the store as one batch, each once.

    The stream's id, which its checkpoint keeps, and the number of its last
    micro-batch are part of the snapshot that adds the batch: a batch that is run
    again after a failure finds its number there, and another stream has an id of its own.
    """
    folder, held = Folder(changes.sparkSession, checkpoint), []

    def one(batch: DataFrame, number: int) -> None:
        if not held:
            held.append(json.loads(folder.read("metadata"))["id"])
        store.write(batch, order, (held[0], number))

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
