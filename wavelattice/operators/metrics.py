"""Separation metrics from one pass of sums and products, masks' scores, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _db(v: Column) -> Column:
    return F.when(v > 0, 10 * F.log10(F.when(v > 0, v)))


def gram(references: DataFrame, estimates: DataFrame) -> DataFrame:
    """Centred inner products by item, channel, reference i and estimate e: ss, ee, se, and mm, ms with the sum of references.

    Samples are joined once on (item, ch, n); everything else is sums with
    map-side partial aggregates.
    """
    key = ["item", "ch", "n"]
    mixed = references.withColumn("m", F.sum("x").over(Window.partitionBy(*key)))
    rows = mixed.select(*key, F.col("label").alias("ref"), F.col("x").alias("s"), "m").join(estimates.select(*key, F.col("label").alias("est"), F.col("x").alias("e")), key)
    sums = rows.groupBy("item", "ch", "ref", "est").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_{c}") for c in "sem"), *(F.sum(F.col(a) * F.col(b)).alias(f"_{a}{b}") for a, b in ("ss", "ee", "se", "mm", "ms")))
    return sums.select("item", "ch", "ref", "est", *((F.col(f"_{a}{b}") - F.col(f"_{a}") * F.col(f"_{b}") / F.col("_n")).alias(a + b) for a, b in ("ss", "ee", "se", "mm", "ms")))


def si_metrics(products: DataFrame) -> DataFrame:
    """SI-SDR, SNR, SRR and SD-SDR of each estimate, and the improvement of SI-SDR and SNR over the mixture."""
    alpha = F.try_divide(F.col("se"), F.col("ss"))
    beta = F.try_divide(F.col("ms"), F.col("ss"))

    def sdr(a: Column, energy: Column, cross: Column) -> Column:
        signal = a * a * F.col("ss")
        return _db(F.try_divide(signal, energy - 2 * a * cross + signal))

    si, mix_si = sdr(alpha, F.col("ee"), F.col("se")), sdr(beta, F.col("mm"), F.col("ms"))
    snr = _db(F.try_divide(F.col("ss"), F.col("ee") - 2 * F.col("se") + F.col("ss")))
    mix_snr = _db(F.try_divide(F.col("ss"), F.col("mm") - 2 * F.col("ms") + F.col("ss")))
    return products.select(
        "item", "ch", "ref", "est", si.alias("si_sdr"), snr.alias("snr"), (-1 * _db((1 - F.try_divide(F.lit(1.0), alpha)) ** 2)).alias("srr"), (snr + _db(alpha * alpha)).alias("sd_sdr"), (si - mix_si).alias("si_sdri"), (snr - mix_snr).alias("snri")
    )


def si_sir_sar(references: DataFrame, estimates: DataFrame, labels: tuple[str, str]) -> DataFrame:
    """SI-SIR and SI-SAR for two references, by the closed 2x2 solution on the span of the references."""
    a, b = labels
    key = ["item", "ch", "n"]
    refs = references.groupBy(*key).agg(*(F.sum(F.when(F.col("label") == v, F.col("x"))).alias(k) for v, k in ((a, "p"), (b, "q"))))
    rows = refs.join(estimates.where(F.col("label").isin(a, b)).select(*key, F.col("label").alias("est"), F.col("x").alias("e")), key)
    pairs = ("pp", "qq", "pq", "pe", "qe", "ee")
    sums = rows.groupBy("item", "ch", "est").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_{c}") for c in "pqe"), *(F.sum(F.col(x[0]) * F.col(x[1])).alias(f"_{x}") for x in pairs))
    g = sums.select("item", "ch", "est", *((F.col(f"_{x}") - F.col(f"_{x[0]}") * F.col(f"_{x[1]}") / F.col("_n")).alias(x) for x in pairs))
    first = F.col("est") == a
    ss, oo = F.when(first, F.col("pp")).otherwise(F.col("qq")), F.when(first, F.col("qq")).otherwise(F.col("pp"))
    se, oe = F.when(first, F.col("pe")).otherwise(F.col("qe")), F.when(first, F.col("qe")).otherwise(F.col("pe"))
    g = g.select("item", "ch", "est", "pq", "ee", ss.alias("ss"), oo.alias("oo"), se.alias("se"), oe.alias("oe")).withColumn("al", F.try_divide(F.col("se"), F.col("ss")))
    g = g.withColumn("r2", F.col("oe") - F.col("al") * F.col("pq")).withColumn("det", F.col("ss") * F.col("oo") - F.col("pq") ** 2)
    interference = F.try_divide(F.col("ss") * F.col("r2") ** 2, F.col("det"))
    signal, noise = F.col("al") ** 2 * F.col("ss"), F.col("ee") - F.col("al") * F.col("se")
    return g.select("item", "ch", "est", _db(F.try_divide(signal, interference)).alias("si_sir"), _db(F.try_divide(signal, F.greatest(noise - interference, F.lit(0.0)))).alias("si_sar"))


def best_permutation(scores: DataFrame, labels: list[str], key: str = "si_sdr") -> DataFrame:
    """item, order, mean: the assignment of estimates to references of the best mean score, first of equals.

    The candidates are few (k! of them) and live in one array literal; scores of an item are one map.
    """
    from itertools import permutations

    by_item = scores.groupBy("item", "ref", "est").agg(F.avg(key).alias("v")).groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(">", "ref", "est"), F.coalesce("v", F.lit(-300.0))))).alias("m"))
    options = []
    for i, p in enumerate(permutations(labels)):
        mean = sum((F.element_at("m", F.lit(f"{r}>{e}")) for r, e in zip(labels, p, strict=True)), F.lit(0.0)) / len(labels)
        options.append(F.struct(F.round(mean, 9).alias("mean"), F.lit(-i).alias("i"), F.lit(",".join(p)).alias("order")))
    return by_item.select("item", F.array_max(F.array(*options)).alias("b")).select("item", "b.order", "b.mean")


def precision_recall(rows: DataFrame, reference: str, estimate: str, *keys: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 columns; 0 where undefined."""
    r, e = F.col(reference) == 1, F.col(estimate) == 1
    cells = rows.groupBy(*keys).agg(F.count_if(r & e).alias("tp"), F.count_if(~r & e).alias("fp"), F.count_if(r & ~e).alias("fn"), F.count(F.lit(1)).alias("n"), F.count_if(r == e).alias("ok"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return cells.select(*keys, ratio(F.col("ok").cast("double"), F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def aggregate_scores(scores: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(source, file, metric columns): median over the values that are numbers."""
    rows = scores.where(~F.isnan("value") & F.col("value").isNotNull())
    return rows.groupBy("source", "file").pivot("metric", metrics).agg(F.median("value"))


def truncated(v: Column, decimals: int = 2) -> Column:
    k = F.lit(float(10**decimals))
    return F.signum(v) * F.floor(F.abs(v) * k) / k


def report_card(frame: DataFrame, metrics: list[str], decimals: int = 2) -> DataFrame:
    """source (OVERALL first level), n, and mean, sample deviation and median of each metric, truncated."""
    numbers = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in metrics]
    rows = frame.select("source", *numbers).rollup("source")
    out = [F.count(F.lit(1)).alias("n")]
    for c in metrics:
        out += [truncated(F.avg(c), decimals).alias(f"{c}_mean"), truncated(F.stddev_samp(c), decimals).alias(f"{c}_std"), truncated(F.median(c), decimals).alias(f"{c}_median")]
    return rows.agg(*out).withColumn("source", F.coalesce("source", F.lit("OVERALL")))


def associate_metrics(frame: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, median, std (of the population), for a model's metadata."""
    rows = frame.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in metrics))).alias("s")).select("s.*")
    return rows.groupBy("metric").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_pop("v").alias("std"))
