"""Behaviour of addresses over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def features(df: DataFrame, ip: str = "src_ip", time: str = "time", port: str = "dst_port", size: str = "bytes", failed: Column | None = None) -> DataFrame:
    """One row per address: events, their rate, failing share, distinct ports, size mean and deviation, hour entropy and deviation, mean gap.

    Two aggregations on the address, one of them over (address, hour) first; the mean gap between events is their
    span over their number, so no window over an address is needed.
    """
    failed = F.col("activity_id") == 2 if failed is None else failed
    hour = F.pmod(F.floor(F.col(time) / F.lit(3_600_000)), F.lit(24))
    whole = df.groupBy(ip).agg(
        F.count("*").alias("events"),
        F.avg(F.when(failed, 1.0).otherwise(0.0)).alias("fail_ratio"),
        F.count_distinct(port).alias("ports"),
        F.avg(size).alias("bytes_mean"),
        F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("bytes_std"),
        F.coalesce(F.stddev_samp(hour), F.lit(0.0)).alias("hour_std"),
        ((F.max(time) - F.min(time)) / F.greatest(F.count("*") - 1, F.lit(1)) / 1000.0).alias("gap_mean"),
        (F.count("*") / F.greatest((F.max(time) - F.min(time)) / 60000.0, F.lit(1.0))).alias("per_minute"),
    )
    hours = df.groupBy(ip, hour.alias("h")).agg(F.count("*").alias("n"))
    # -sum(p log p) = log(N) - sum(n log n) / N
    entropy = hours.groupBy(ip).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("hour_entropy"))
    return whole.join(entropy, ip)


def rates(df: DataFrame, ip: str = "src_ip", time: str = "time", every: str = "1 minute") -> DataFrame:
    """Events of each address in each interval."""
    return df.groupBy(ip, F.window(F.timestamp_millis(time), every).alias("w")).agg(F.count("*").alias("n")).select(ip, F.col("w.start").alias("start"), "n")


def unusual(df: DataFrame, ip: str = "src_ip", time: str = "time", back: int = 24, beyond: float = 3.0) -> DataFrame:
    """Hourly counts of each address beside the mean and deviation of its last ``back`` hours seen, and whether z exceeds ``beyond``."""
    hourly = df.groupBy(ip, F.floor(F.col(time) / F.lit(3_600_000)).alias("hour")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(ip).orderBy("hour").rowsBetween(-back, -1)
    rows = hourly.withColumns({"mean": F.avg("n").over(before), "std": F.stddev_samp("n").over(before)})
    z = F.when(F.col("std") > 0, (F.col("n") - F.col("mean")) / F.col("std"))
    return rows.withColumn("z", z).withColumn("flag", F.coalesce(F.col("z") > beyond, F.lit(False)))


def outliers(rows: DataFrame, columns: list[str], share: float = 0.1) -> DataFrame:
    """A robust score of each row, the largest distance from a column's median in quartile ranges, and the top ``share`` flagged."""
    stats = rows.agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 10000).alias(c) for c in columns]).first()
    parts = []
    for c in columns:
        low, mid, high = stats[c] or (0, 0, 0)
        parts.append(F.abs(F.col(c) - F.lit(float(mid))) / F.lit(max(float(high - low), 1e-9)))
    scored = rows.withColumn("score", F.greatest(*parts) if len(parts) > 1 else parts[0])
    cut = scored.agg(F.percentile_approx("score", 1 - share, 10000)).first()[0]
    return scored.withColumn("flag", F.col("score") >= F.lit(cut if cut is not None else 0.0))


def sessions(df: DataFrame) -> DataFrame:
    """Built connections with the next event of their identifier in time, if that is a teardown; identifiers come again."""
    keyed = df.withColumn("connection", F.try_element_at("unmapped", F.lit("asa.connection_id"))).filter(F.col("connection").isNotNull())
    keyed = keyed.filter(F.col("action").isin("Built", "Teardown")).select("connection", "action", "time", "src_endpoint", "dst_endpoint", F.col("traffic.bytes").alias("bytes"))
    after = F.lead(F.struct("action", "time", "bytes")).over(Window.partitionBy("connection").orderBy("time", "action"))
    pairs = keyed.withColumn("after", after).filter((F.col("action") == "Built") & (F.col("after.action") == "Teardown"))
    return pairs.select("connection", F.col("time").alias("begun"), "src_endpoint", "dst_endpoint", F.col("after.time").alias("ended"), F.col("after.bytes").alias("bytes"))
