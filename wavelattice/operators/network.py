"""Losses over sets of sources and the projections of a network's front end, as aggregations."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def amplitude_to_db(x: Column, ref: float = 1.0, amin: float = 1e-4) -> Column:
    """Decibels of an amplitude, not under amin, less ref."""
    return 10 * F.log10(F.greatest(x * x, F.lit(amin * amin))) - ref


def si_sdr_loss(scores: DataFrame) -> DataFrame:
    """item, loss: mean over pairs of the negative SI-SDR with 1e-8 inside the logarithm."""
    ratio = F.pow(F.lit(10.0), F.col("si_sdr") / 10)
    return scores.groupBy("item").agg(F.avg(-10 * F.log10(ratio + 1e-8)).alias("loss"))


def invariant_loss(targets: DataFrame, estimates: DataFrame, target_labels: list[str], estimate_labels: list[str], loss: Callable[[Column], Column] = F.abs) -> DataFrame:
    """item, loss: least mean loss over every way to give each target its own estimate.

    With as many estimates as targets that is permutation invariance, with more
    it is combination invariance. Samples are brought together by one grouping
    and each pair of labels is one partial aggregate.
    """
    if len(estimate_labels) < len(target_labels):
        raise ValueError("there are fewer estimates than targets")
    tagged = targets.select("item", "ch", "n", F.lit("t").alias("side"), "label", "x").unionByName(estimates.select("item", "ch", "n", F.lit("e").alias("side"), "label", "x"))
    named = [(s, k, v) for s, labels in (("t", target_labels), ("e", estimate_labels)) for k, v in enumerate(labels)]
    wide = tagged.groupBy("item", "ch", "n").agg(*(F.coalesce(F.sum(F.when((F.col("side") == s) & (F.col("label") == v), F.col("x"))), F.lit(0.0)).alias(f"{s}{k}") for s, k, v in named))
    pairs = [(e, t) for e in range(len(estimate_labels)) for t in range(len(target_labels))]
    means = wide.groupBy("item").agg(*(F.avg(loss(F.col(f"e{e}") - F.col(f"t{t}"))).alias(f"l{e}_{t}") for e, t in pairs))
    ways = [sum((F.col(f"l{e}_{t}") for t, e in enumerate(way)), F.lit(0.0)) / len(target_labels) for way in permutations(range(len(estimate_labels)), len(target_labels))]
    return means.select("item", F.array_min(F.array(*ways)).alias("loss"))


def _mel(hz: float) -> float:
    return hz * 3 / 200 if hz < 1000 else 15 + math.log(hz / 1000) * 27 / math.log(6.4)


def _hz(mel: float) -> float:
    return mel * 200 / 3 if mel < 15 else 1000 * math.exp((mel - 15) * math.log(6.4) / 27)


def mel_weights(rate: int, bins: int, mels: int) -> list[tuple[int, int, float]]:
    """(f, mel, weight): triangles over a scale linear to 1000 Hz and logarithmic above; the weights of a mel sum to 1."""
    edges = [_hz(_mel(rate / 2) * k / (mels + 1)) for k in range(mels + 2)]
    out = []
    for m in range(mels):
        low, mid, high = edges[m : m + 3]
        at = [(f, f * rate / 2 / (bins - 1)) for f in range(bins)]
        row = [(f, max(0.0, min((hz - low) / (mid - low), (high - hz) / (high - mid)))) for f, hz in at]
        total = sum(w for _, w in row)
        out += [(f, m, w / total) for f, w in row if w > 0]
    return out


def mel_projection(frame: DataFrame, value: str, rate: int, bins: int, mels: int) -> DataFrame:
    """item, ch, t, mel, v. The weights, two to a bin at most, go to every task; their size depends on bins alone."""
    weights = frame.sparkSession.createDataFrame(mel_weights(rate, bins, mels), "f long, mel int, w double")
    return frame.join(F.broadcast(weights), "f").groupBy("item", "ch", "t", "mel").agg(F.sum(F.col(value) * F.col("w")).alias("v"))
