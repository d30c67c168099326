"""Bounded ingestion of a stream into a Parquet table with exactly-once batches, minimised on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hushframe.errors import DataError
from hushframe.functions import names as N
from hushframe.types import quoted


def drop_named_pii(stream: DataFrame, question: str = "") -> DataFrame:
    """A stream without the columns whose names suggest personal data that the question does not name (values are not scanned)."""
    keep = [c for c in stream.columns if N.pii_kind(c) is None or N.mentioned(question, c)]
    return stream.select(*map(quoted, keep))


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is available now; the Parquet sink's log makes a repeated batch harmless."""
    if not stream.isStreaming:
        raise DataError("ingest takes a streaming frame")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
