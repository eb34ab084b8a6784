"""The same features over a stream of samples: windowed aggregates with a watermark; late samples beyond it are dropped by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def speed_windows(samples: DataFrame, window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Streaming or batch (trip_id, timestamp, speed, event) -> per trip and window: samples, mean and largest speed, labelled samples."""
    rows = samples.withWatermark("timestamp", late)
    return rows.groupBy("trip_id", F.window("timestamp", window).alias("w")).agg(F.count("*").alias("n"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("max_speed"), F.count("event").alias("n_events")).select("trip_id", F.col("w.start").alias("start"), "n", "mean_speed", "max_speed", "n_events")
