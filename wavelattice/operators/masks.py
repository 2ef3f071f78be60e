"""Time-frequency masks: oracle, algebraic and filter masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spectral import magnitude

CELL = ["item", "ch", "t", "f"]


def ideal_binary(source_spectra: DataFrame) -> DataFrame:
    """1 where a source alone has the cell's largest magnitude; ties give 0 to all."""
    w = Window.partitionBy(*CELL)
    rows = source_spectra.withColumn("_m", F.round(magnitude(), 9))
    rows = rows.withColumn("_top", F.col("_m") == F.max("_m").over(w))
    alone = F.sum(F.col("_top").cast("int")).over(w) == 1
    return rows.select("item", F.col("label").alias("src"), "ch", "t", "f", (F.col("_top") & alone).cast("int").cast("double").alias("m"))


def beside_mix(source_spectra: DataFrame) -> DataFrame:
    """Source spectra with the sum of the cell's sources, xr and xi. A window: a join would deal the cells anew, to tasks that do not follow the input."""
    w = Window.partitionBy(*CELL)
    return source_spectra.withColumns({"xr": F.sum("re").over(w), "xi": F.sum("im").over(w)})


def ideal_ratio(source_spectra: DataFrame, mix_spectra: DataFrame | None = None, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Share of a source's magnitude among all sources; with a mix (spectra, or xr and xi beside the sources), the magnitude in the mix's phase, clipped to [low, high * mix]."""
    rows = source_spectra
    if mix_spectra is not None:
        rows = rows.join(mix_spectra.select(*CELL, F.col("re").alias("xr"), F.col("im").alias("xi")), CELL)
    if "xr" in rows.columns:
        x = magnitude("xr", "xi")
        along = F.coalesce(F.try_divide(F.col("re") * F.col("xr") + F.col("im") * F.col("xi"), x), F.col("re"))
        rows = rows.withColumn("_s", F.least(F.greatest(along, F.lit(low)), x * high))
    else:
        rows = rows.withColumn("_s", magnitude())
    share = F.col("_s") / (F.sum("_s").over(Window.partitionBy(*CELL)) + 1e-8)
    return rows.select("item", F.col("label").alias("src"), "ch", "t", "f", share.alias("m"))


def invert(m: Column) -> Column:
    return F.abs(1 - m)


def to_binary(m: Column, threshold: float = 0.5) -> Column:
    if not 0 < threshold < 1:
        raise ValueError("threshold is between 0 and 1")
    return (m > threshold).cast("int")


def validated_binary(m: Column) -> Column:
    """Cells within 0.01 of 0 or 1, cast as any nonzero value is true; others raise."""
    near = (F.abs(m) <= 1e-2) | (F.abs(m - 1) <= 1e-2)
    return F.when(near, (m != 0).cast("int")).otherwise(F.raise_error(F.lit("a binary mask holds 0 and 1 only")).cast("int"))


def combine(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    """Cell-wise a + scale * b."""
    key = ["item", "src", *CELL[1:]]
    return a.select(*key, "m").unionByName(b.select(*key, (F.col("m") * scale).alias("m"))).groupBy(*key).agg(F.sum("m").alias("m"))


def apply(spectra: DataFrame, masks: DataFrame, per_channel: bool = True) -> DataFrame:
    """(item, src, ch, t, f, re, im): spectra (a row a cell) times masks; without per_channel one mask serves all channels.

    With per_channel the cell's spectrum comes to its masks by a window over both, see beside_mix.
    """
    if per_channel:
        both = masks.select("src", *CELL, "m").unionByName(spectra.select(*CELL, "re", "im", F.lit(True).alias("_z")), allowMissingColumns=True)
        w = Window.partitionBy(*CELL)
        rows = both.withColumns({c: F.max(c).over(w) for c in ("re", "im")} | {"_has": F.max("_z").over(w)}).where("_z is null and _has")
    else:
        rows = spectra.join(masks.select("src", "item", "t", "f", "m"), ["item", "t", "f"])
    return rows.select("item", "src", "ch", "t", "f", (F.col("re") * F.col("m")).alias("re"), (F.col("im") * F.col("m")).alias("im"))


def high_low_pass(bins: int, rate: int, cutoff: float) -> tuple[int, Column, Column]:
    """Cut bin (nearest to the cutoff, first of equals), low mask and high mask by f."""
    grid = [k * (rate // 2) / (bins - 1) for k in range(bins)]
    cut = min(range(bins), key=lambda k: (abs(grid[k] - cutoff), k))
    low = (F.col("f") < cut).cast("int").cast("double")
    return cut, low, 1 - low


def magnitude_weights(spectra: DataFrame) -> DataFrame:
    """Square root of a cell's share of the item's magnitude times its number of cells in a channel."""
    w = Window.partitionBy("item")
    rows = spectra.withColumn("_m", magnitude()).withColumn("_c", (F.max("t").over(w) + 1) * (F.max("f").over(w) + 1))
    return rows.select(*CELL, F.sqrt(F.col("_m") / (F.sum("_m").over(w) + 1e-6) * F.col("_c")).alias("weight"))


def mix_as_estimate(signals: DataFrame, count: int) -> DataFrame:
    """count copies of the mix, as a lower bound."""
    return signals.select("item", F.explode(F.array(*map(F.lit, range(count)))).alias("src"), "ch", "n", "x")


def ones(spectra: DataFrame, value: float = 1.0) -> DataFrame:
    """A mask of one value (zeros with 0) in the shape of the spectra."""
    return spectra.select("item", F.lit(0).alias("src"), "ch", "t", "f", F.lit(float(value)).alias("m"))


def equal(a: DataFrame, b: DataFrame, digits: int = 9) -> DataFrame:
    """item, equal: whether two masks agree in every cell, rounded."""
    key = ["item", "src", *CELL[1:]]
    side = lambda m, k: m.select(*(F.col(c).cast("string") if c == "src" else F.col(c) for c in key), F.round("m", digits).alias("m"), F.lit(k).alias("side"))
    cells = side(a, 1).unionByName(side(b, -1)).groupBy(*key, "m").agg(F.sum("side").alias("gap"))
    return cells.groupBy("item").agg((F.max(F.abs("gap")) == 0).alias("equal"))
