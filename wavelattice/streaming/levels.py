"""Level meters of a stream of samples (an addition: the batch operators have no streams)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def levels(samples: DataFrame, time: str, value: str, key: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """RMS and peak by key and time window; state is kept until the watermark passes."""
    x = F.col(value)
    return samples.withWatermark(time, late).groupBy(key, F.window(time, window).alias("w")).agg(F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak")).select(key, F.col("w.start").alias("start"), "rms", "peak")
