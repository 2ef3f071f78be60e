"""Sample effects on long signals (item, ch, n, x) as expressions over neighbouring samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def emphasis(signals: DataFrame, amount: float = 0.95) -> DataFrame:
    """x[n] - amount * x[n - 1]; nothing stands before the first sample."""
    w = Window.partitionBy("item", "ch").orderBy("n")
    return signals.select("item", "ch", "n", (F.col("x") - amount * F.lag("x", 1, 0.0).over(w)).alias("x"))


def echo(signals: DataFrame, delays: list[int], decays: list[float], dry: float = 1.0) -> DataFrame:
    """dry * x plus a copy for each delay (in samples) and decay; the signal keeps its length. One aggregation, no join."""
    if len(delays) != len(decays) or any(k < 1 for k in delays):
        raise ValueError("as many decays as delays, each of one sample or more")
    taps = F.array(*(F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(float(g)).alias("g")) for k, g in zip([0, *delays], [dry, *decays], strict=True)))
    size = F.max("n").over(Window.partitionBy("item", "ch"))
    spread = signals.select("item", "ch", "n", "x", size.alias("last")).select("item", "ch", "n", "x", "last", F.explode(taps).alias("t"))
    moved = spread.select("item", "ch", (F.col("n") + F.col("t.k")).alias("n"), (F.col("x") * F.col("t.g")).alias("x"), "last").where("n <= last")
    return moved.groupBy("item", "ch", "n").agg(F.sum("x").alias("x"))


def modulated_delay(signals: DataFrame, rate: int, least: float, depth: float, frequency: float, dry: float = 0.0, wet: float = 1.0) -> DataFrame:
    """dry * x plus wet * x delayed by least + depth * (1 + sin) / 2 samples, between neighbours linearly.

    With dry 0 it is a vibrato, with a dry part and a delay of some milliseconds
    a chorus, with a shorter one a flanger. Silence stands before the first sample.
    """
    late = F.lit(least) + F.lit(depth) * (1 + F.sin(F.lit(2 * math.pi * frequency / rate) * F.col("n"))) / 2
    rows = signals.select("item", "ch", "n", "x", F.round(late, 9).alias("late")).withColumn("whole", F.floor("late"))
    taps = F.array(*(F.struct((F.col("n") - F.col("whole") - k).alias("m"), share.alias("g")) for k, share in ((0, 1 - (F.col("late") - F.col("whole"))), (1, F.col("late") - F.col("whole")))))
    wanted = rows.select("item", "ch", "n", F.explode(taps).alias("t")).select("item", "ch", "n", F.col("t.m").alias("m"), F.col("t.g").alias("g"))
    from_ = signals.select("item", "ch", F.col("n").alias("m"), F.col("x").alias("y"))
    delayed = wanted.join(from_, ["item", "ch", "m"]).select("item", "ch", "n", (F.col("g") * F.col("y") * wet).alias("x"))
    return signals.select("item", "ch", "n", (F.col("x") * dry).alias("x")).unionByName(delayed).groupBy("item", "ch", "n").agg(F.sum("x").alias("x"))


def compress(signals: DataFrame, threshold: float, ratio: float, makeup: float = 1.0) -> DataFrame:
    """Magnitudes above the threshold grow by 1 / ratio only, without attack or release."""
    if threshold <= 0 or ratio < 1:
        raise ValueError("a positive threshold, a ratio of 1 or more")
    size = F.abs("x")
    return signals.withColumn("x", F.when(size > threshold, F.signum("x") * (threshold + (size - threshold) / ratio)).otherwise(F.col("x")) * makeup)
