"""Short-time Fourier transform, its inverse, and spectral columns.

Two forms: relational (any engine, checked against SQL) and packed (NumPy FFT
in Arrow batches by item, for speed).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TF = ["item", "ch", "t", "f"]


def window_weight(k: Column, length: int, kind: str = "sqrt_hann") -> Column:
    """Periodic window by place k."""
    turn = F.lit(2 * math.pi / length) * k
    forms = {
        "hann": 0.5 - 0.5 * F.cos(turn),
        "hanning": 0.5 - 0.5 * F.cos(turn),
        "hamming": 0.54 - 0.46 * F.cos(turn),
        "blackman": 0.42 - 0.5 * F.cos(turn) + 0.08 * F.cos(2 * turn),
        "sqrt_hann": F.sqrt(F.greatest(F.lit(0.0), 0.5 - 0.5 * F.cos(turn))),
        "rectangular": F.lit(1.0) + 0 * turn,
    }
    return forms[kind]


def window_array(length: int, kind: str = "sqrt_hann") -> np.ndarray:
    turn = 2 * np.pi * np.arange(length) / length
    return {"hann": 0.5 - 0.5 * np.cos(turn), "hamming": 0.54 - 0.46 * np.cos(turn), "sqrt_hann": np.sqrt(np.maximum(0, 0.5 - 0.5 * np.cos(turn))), "rectangular": np.ones(length)}[kind]


def default_window(rate: int) -> tuple[int, int]:
    length = 2 ** math.ceil(math.log2(0.032 * rate))
    return length, length // 4


def frames(signals: DataFrame, length: int, hop: int, *by: str) -> DataFrame:
    """(item, by, ch, t, k, x): the signal with half a window of zeros on both sides, cut into whole frames."""
    half = length // 2
    last = F.ceil((F.max("n").over(Window.partitionBy("item")) + 1) / F.lit(hop)).cast("bigint")
    first = F.greatest(F.lit(0), F.ceil((F.col("n") + half - length + 1) / F.lit(hop))).cast("bigint")
    rows = signals.select("item", *by, "ch", "n", "x", first.alias("a"), F.least(last, F.floor((F.col("n") + half) / F.lit(hop))).cast("bigint").alias("b")).where("a <= b")
    return rows.select("item", *by, "ch", "n", "x", F.explode(F.sequence("a", "b")).alias("t")).select("item", *by, "ch", "t", (F.col("n") + half - F.col("t") * hop).alias("k"), "x")


def stft(signals: DataFrame, length: int, hop: int, kind: str = "sqrt_hann", by: tuple[str, ...] = ()) -> DataFrame:
    """(item, by, ch, t, f, re, im), one-sided, scaled by the window's sum; by are columns that tell signals of an item apart."""
    scale = float(window_array(length, kind).sum())
    rows = frames(signals, length, hop, *by).withColumn("x", F.col("x") * window_weight(F.col("k"), length, kind) / scale)
    rows = rows.select("item", *by, "ch", "t", "k", "x", F.explode(F.sequence(F.lit(0), F.lit(length // 2)).cast("array<bigint>")).alias("f"))
    turn = F.lit(2 * math.pi / length) * F.pmod(F.col("k") * F.col("f"), F.lit(length))
    return rows.groupBy("item", *by, *TF[1:]).agg(F.sum(F.col("x") * F.cos(turn)).alias("re"), F.sum(-F.col("x") * F.sin(turn)).alias("im"))


def istft(spectra: DataFrame, sizes: DataFrame, length: int, hop: int, kind: str = "sqrt_hann") -> DataFrame:
    """Signals of spectra by overlap-add over the squared window; sizes has item, length."""
    scale, half = float(window_array(length, kind).sum()), length // 2
    rows = spectra.select(*TF, "re", "im", F.explode(F.sequence(F.lit(0), F.lit(length - 1)).cast("array<bigint>")).alias("k"))
    turn = F.lit(2 * math.pi / length) * F.pmod(F.col("k") * F.col("f"), F.lit(length))
    twice = F.when(F.col("f").isin(0, half), 1.0).otherwise(2.0)
    weight = window_weight(F.col("k"), length, kind)
    frame = rows.groupBy("item", "ch", "t", "k").agg((F.sum(twice * (F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn))) * (scale / length)).alias("y"))
    summed = frame.select("item", "ch", (F.col("t") * hop + F.col("k") - half).alias("n"), (F.col("y") * weight).alias("y"), (weight * weight).alias("w")).groupBy("item", "ch", "n").agg(F.sum("y").alias("y"), F.sum("w").alias("w"))
    value = F.when(F.col("w") > 1e-10, F.col("y") / F.col("w")).otherwise(F.col("y"))
    return summed.join(sizes.select("item", "length"), "item").where((F.col("n") >= 0) & (F.col("n") < F.col("length"))).select("item", "ch", "n", value.alias("x"))


def stft_array(x: np.ndarray, length: int, hop: int, kind: str = "sqrt_hann") -> np.ndarray:
    """(frequency, frame) of one channel; the same transform in NumPy."""
    w = window_array(length, kind)
    count = -(-len(x) // hop) + 1
    padded = np.zeros((count - 1) * hop + length)
    padded[length // 2 : length // 2 + len(x)] = x
    cut = np.lib.stride_tricks.sliding_window_view(padded, length)[::hop]
    return np.fft.rfft(cut * w, axis=1).T / w.sum()


def istft_array(spectrum: np.ndarray, length: int, hop: int, size: int, kind: str = "sqrt_hann") -> np.ndarray:
    w = window_array(length, kind)
    cut = np.fft.irfft(spectrum.T * w.sum(), n=length, axis=1) * w
    count, parts = len(cut), -(-length // hop)
    out, norm = np.zeros((count + parts, hop)), np.zeros((count + parts, hop))
    for k in reversed(range(parts)):  # all frames at once, hop by hop; each sample still sums its frames in their order
        part = slice(k * hop, min((k + 1) * hop, length))
        out[k : k + count, : part.stop - part.start] += cut[:, part]
        norm[k : k + count, : part.stop - part.start] += (w * w)[part]
    out, norm = (x.ravel()[: (count - 1) * hop + length] for x in (out, norm))
    out = np.where(norm > 1e-10, out / np.maximum(norm, 1e-10), out)[length // 2 : length // 2 + size]
    return np.pad(out, (0, size - len(out)))


def stft_packed(signals: DataFrame, length: int, hop: int, kind: str = "sqrt_hann") -> DataFrame:
    """The same rows as stft, by NumPy's FFT, one (item, ch) at a time."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("n")
        z = stft_array(pdf.x.to_numpy(), length, hop, kind)
        f, t = np.indices(z.shape)
        return pd.DataFrame({"item": pdf.item.iloc[0], "ch": pdf.ch.iloc[0], "t": t.ravel(), "f": f.ravel(), "re": z.real.ravel(), "im": z.imag.ravel()})

    return signals.select("item", "ch", "n", "x").groupBy("item", "ch").applyInPandas(run, "item string, ch int, t long, f long, re double, im double")


def magnitude(re="re", im="im") -> Column:
    return F.sqrt(F.col(re) * F.col(re) + F.col(im) * F.col(im))


def power(re="re", im="im") -> Column:
    return F.col(re) * F.col(re) + F.col(im) * F.col(im)


def log_magnitude() -> Column:
    return 20 * F.log10(magnitude() + F.lit(1e-8))


def frequency(f: Column, rate: int, bins: int) -> Column:
    """From 0 to half the rate (whole Hertz), both ends included."""
    return f * F.lit((rate // 2) / (bins - 1))


def ipd_ild(spectra: DataFrame, one: int = 0, two: int = 1) -> DataFrame:
    """(item, t, f, ipd, ild) of two channels. One aggregation instead of a self-join."""
    pick = lambda c, ch: F.max(F.when(F.col("ch") == ch, F.col(c)))
    both = spectra.where(F.col("ch").isin(one, two)).groupBy("item", "t", "f").agg(pick("re", one).alias("ar"), pick("im", one).alias("ai"), pick("re", two).alias("br"), pick("im", two).alias("bi"))
    ild = 20 * F.log10(magnitude("ar", "ai") / (magnitude("br", "bi") + 1e-4) + 1e-8)
    angle = F.atan2(F.col("bi") * F.col("ar") - F.col("br") * F.col("ai"), F.col("br") * F.col("ar") + F.col("bi") * F.col("ai"))
    return both.select("item", "t", "f", F.pmod(angle / (F.col("f") + 1), F.lit(math.pi)).alias("ipd"), ild.alias("ild"))


def loud_bins(spectra: DataFrame, percent: float = 95) -> DataFrame:
    """Bins whose magnitude is over the item's percentile (linear interpolation)."""
    rows = spectra.withColumn("mag", F.round(magnitude(), 9))
    cut = rows.groupBy("item").agg(F.percentile("mag", percent / 100).alias("cut"))
    return rows.join(cut, "item").where(F.col("mag") > F.col("cut"))
