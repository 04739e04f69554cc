"""The same projection on a stream: follow files, normalize, drop what came before, write events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.normalize import accepted, normalize


def events(lines: DataFrame, late: str = "30 days", **options) -> DataFrame:
    """Valid events of a stream of lines; one whose identifier came within ``late`` before is dropped.

    Identifiers depend on the line only, so a batch that runs again gives the same ones.
    """
    df = accepted(normalize(lines, **options)).withColumn("event_ts", F.timestamp_millis("time")).withColumn("event_id", F.col("metadata.uid"))
    return df.withWatermark("event_ts", late).dropDuplicatesWithinWatermark(["source", "event_id"])


def store(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes events by date and source; without an interval what is there is read once, and the query ends.

    After a failure the checkpoint leads on from the last finished batch, and files of unfinished ones are ignored.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("event_date", "source")
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.outputMode("append").trigger(**trigger).start()


def rates(stream: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events of each source in each interval of event time; later ones than the watermark are left out."""
    return stream.withWatermark("event_ts", late).groupBy(F.window("event_ts", every), "source").count()
