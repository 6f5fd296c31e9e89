"""An addition of this engine: running per-key counts and means over a stream, late events dropped."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling windows per key; append mode gives each once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "count", "mean")
