"""Reading and writing line-delimited logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.export import ocsf_json
from .synth import lines_of


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row a line: value and the file it is from. Lines of any length are read."""
    return spark.read.text(path).withColumn("file", F.input_file_name())


def follow_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the lines of files as they come; the number of files per batch bounds its load."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of the lines of a TCP connection, for trials: it can't be read again after a failure."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def merged(*feeds: DataFrame) -> DataFrame:
    """Several feeds as one."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).alias("value")).write.text(path)


def write_jsonl(events: DataFrame, path: str, by_source: bool = False) -> None:
    """Appends normalized events to a lake of JSON lines, one OCSF object a line; in a folder for each source, if asked for."""
    rows = events.select("source", ocsf_json().alias("value")) if by_source else events.select(ocsf_json().alias("value"))
    writer = rows.write.mode("append")
    (writer.partitionBy("source") if by_source else writer).text(path)


def timed_feed(spark: SparkSession, vendor: str, every: float = 2.0, batch: int = 25, seed: int = 42) -> DataFrame:
    """A stream of synthetic lines of a vendor, for trials: ``batch`` lines in ``every`` seconds on average, each with its time.

    Line i depends on i and the seed only, so a batch that runs again gives the same lines.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", max(1, round(batch / every))).load()
    return lines_of(ticks.select(F.col("value").alias("i"), "timestamp"), vendor, seed, "timestamp")
