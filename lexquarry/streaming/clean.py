"""Line cleaning over a stream of documents.

Splitting, normalising and drop rules look at a line alone, so they run on a stream as they do on a table, without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexquarry.operators import corpus as C


def cleaned_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return C.clean(C.lines(spark.readStream.schema(schema).parquet(path)))


def write_cleaned(cleaned: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Kept lines, and blank ones that end a paragraph, to Parquet; what is there is taken and the query ends."""
    kept = cleaned.where("reason is null or reason = 'blank'")
    return kept.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
