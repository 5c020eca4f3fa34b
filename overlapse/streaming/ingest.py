"""Incremental ingest: new files as a stream, each batch checked against what is known."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from overlapse.schemas import schema_of
from overlapse.sources.catalog import Catalog
from overlapse.sources.files import exact_duplicates, known_paths
from overlapse.workspace import materialise, remove


def ingest_stream(spark: SparkSession, arrivals: DataFrame, root: str, checkpoint: str, identify: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Start a stream of arrivals (path, mtime, size_bytes, ...) into the catalog below ``root``.

    ``identify`` gives a batch its content_id and the other columns of the file table. Paths
    that are known, as exact duplicates too, are skipped; a batch that is delivered again after
    a failure changes nothing, as upserts are keyed. Runs until all that has arrived is done.
    """

    def step(batch: DataFrame, _: int) -> None:
        catalog = Catalog(batch.sparkSession, root)
        fresh = batch.join(known_paths(catalog.read("file"), catalog.read("dup_path")), "path", "left_anti")
        marked = materialise(exact_duplicates(identify(fresh), catalog.read("file")), "arrivals")
        try:
            catalog.insert_absent("dup_path", marked.filter("status = 'duplicate'"))
            catalog.upsert("file", marked.filter("status = 'new'").select(*schema_of("file").names))
        finally:
            remove(marked)

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
