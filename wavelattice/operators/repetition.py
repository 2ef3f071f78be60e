"""Repeating patterns: beat spectrum, period, repeating mask, frame similarity, median filters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spectral import magnitude, power


def beat_spectrum(spectra: DataFrame) -> DataFrame:
    """(item, ch, lag, v): autocorrelation over frames of the power, averaged over lag pairs and bins.

    Frames of one bin are packed into an array, so lag products stay in one row.
    """
    packed = spectra.select("item", "ch", "f", "t", power().alias("p")).groupBy("item", "ch", "f").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "p"))), lambda s: s["p"]).alias("p"))
    rows = packed.select("item", "ch", "f", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("lag"))
    head = F.slice("p", F.lit(1), F.size("p") - F.col("lag"))
    tail = F.slice("p", F.col("lag") + 1, F.size("p") - F.col("lag"))
    products = F.aggregate(F.zip_with(head, tail, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return rows.select("item", "ch", "lag", (products / (F.size("p") - F.col("lag"))).alias("v")).groupBy("item", "ch", "lag").agg(F.avg("v").alias("v"))


def repeating_period(beats: DataFrame, least: int, most: int) -> DataFrame:
    """item, ch, period: the lag of the highest beat in [least, most], first of equals; lag 0 never."""
    rows = beats.where(F.col("lag").between(max(least, 1), most)).withColumn("v", F.round("v", 9))
    return rows.groupBy("item", "ch").agg(F.max_by("lag", F.struct("v", -F.col("lag"))).alias("period"))


def repeating_mask(spectra: DataFrame, periods: DataFrame) -> DataFrame:
    """Median over repetitions, no more than the cell itself, as a share of it."""
    rows = spectra.withColumn("_m", magnitude()).join(periods.select("item", "ch", "period"), ["item", "ch"])
    again = Window.partitionBy("item", "ch", "f", F.pmod(F.col("t"), F.col("period")))
    model = F.least(F.col("_m"), F.median("_m").over(again))
    return rows.select("item", "ch", "t", "f", ((model + 1e-16) / (F.col("_m") + 1e-16)).alias("m"))


def similarity_matrix(spectra: DataFrame) -> DataFrame:
    """(item, i, j, s): cosine of channel-mean magnitudes of frame pairs; silent frames give 0.

    Frames are packed into one array each; the pairs are those of one item, which the result holds anyway.
    """
    cells = spectra.groupBy("item", "t", "f").agg(F.avg(magnitude()).alias("m"))
    frames = cells.groupBy("item", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "m"))), lambda s: s["m"]).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    frames = frames.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    a, b = frames.select("item", F.col("t").alias("i"), F.col("v").alias("a"), F.col("norm").alias("an")), frames.select("item", F.col("t").alias("j"), F.col("v").alias("b"), F.col("norm").alias("bn"))
    return a.join(b, "item").select("item", "i", "j", F.coalesce(F.try_divide(dot(F.col("a"), F.col("b")), F.col("an") * F.col("bn")), F.lit(0.0)).alias("s"))


def hpss(spectra: DataFrame, kernel: int = 31) -> DataFrame:
    """(item, ch, t, f, harmonic, percussive): soft masks of running medians along time and along frequency."""
    half = kernel // 2
    rows = spectra.withColumn("_m", magnitude())
    along_t = Window.partitionBy("item", "ch", "f").orderBy("t").rowsBetween(-half, half)
    along_f = Window.partitionBy("item", "ch", "t").orderBy("f").rowsBetween(-half, half)
    rows = rows.select("item", "ch", "t", "f", F.percentile("_m", 0.5).over(along_t).alias("h"), F.percentile("_m", 0.5).over(along_f).alias("p"))
    h, p = F.col("h") ** 2, F.col("p") ** 2
    return rows.select("item", "ch", "t", "f", F.coalesce(F.try_divide(h, h + p), F.lit(0.5)).alias("harmonic"), F.coalesce(F.try_divide(p, h + p), F.lit(0.5)).alias("percussive"))


def top_similar(similar: DataFrame, count: int, threshold: float = 0.0) -> DataFrame:
    """(item, i, j, rank): for each frame the most similar others, first of equals."""
    w = Window.partitionBy("item", "i").orderBy(F.round("s", 9).desc(), "j")
    rows = similar.where((F.col("i") != F.col("j")) & (F.col("s") >= threshold)).withColumn("rank", F.row_number().over(w))
    return rows.where(F.col("rank") <= count).select("item", "i", "j", F.col("rank").cast("bigint").alias("rank"))


def similar_mask(spectra: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Median over similar frames, no more than the cell, as a share of it; frames without any keep all."""
    rows = spectra.withColumn("_m", magnitude())
    other = rows.select("item", "ch", F.col("t").alias("j"), "f", F.col("_m").alias("o"))
    model = neighbours.select("item", "i", "j").join(other, ["item", "j"]).groupBy("item", "ch", F.col("i").alias("t"), "f").agg(F.median("o").alias("o"))
    joined = rows.join(model, ["item", "ch", "t", "f"], "left")
    return joined.select("item", "ch", "t", "f", ((F.least(F.col("_m"), F.coalesce("o", F.lit(1.0))) + 1e-16) / (F.col("_m") + 1e-16)).alias("m"))


def reorder_correlation(chunks: DataFrame, hop: int) -> DataFrame:
    """(item, chunk, a, b, r): correlation of the overlap of source a in a chunk with source b in the chunk before."""
    now = chunks.where(F.col("n") < hop).select("item", "chunk", F.col("label").alias("a"), "n", F.col("x").alias("xa"))
    before = chunks.where(F.col("n") >= hop).select("item", (F.col("chunk") + 1).alias("chunk"), F.col("label").alias("b"), (F.col("n") - hop).alias("n"), F.col("x").alias("xb"))
    return now.join(before, ["item", "chunk", "n"]).groupBy("item", "chunk", "a", "b").agg(F.coalesce(F.corr("xa", "xb"), F.lit(0.0)).alias("r"))


def high_pass_guard(masks: DataFrame, cutoff: float, rate: int, bins: int) -> DataFrame:
    """Cells up to the cutoff count as background."""
    low = math.ceil(cutoff / ((rate // 2) / (bins - 1)))
    return masks.withColumn("m", F.when(F.col("f") < low, 1.0).otherwise(F.col("m")))
