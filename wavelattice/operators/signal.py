"""Sample-wise operators on long signals (item, ch, n, x)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["item", "ch", "n"]


def shape(signals: DataFrame, rate: int) -> DataFrame:
    """item, length, channels, duration in seconds."""
    sizes = signals.groupBy("item").agg((F.max("n") + 1).alias("length"), (F.max("ch") + 1).alias("channels"))
    return sizes.withColumn("duration", F.col("length") / F.lit(float(rate)))


def time_vector(sizes: DataFrame) -> DataFrame:
    """item, n, seconds: a grid from 0 to the duration, both ends included."""
    rows = sizes.select("item", "length", "duration", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)).alias("n"))
    return rows.select("item", "n", F.coalesce(F.try_divide(F.col("n") * F.col("duration"), F.col("length") - 1), F.lit(0.0)).alias("seconds"))


def add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Sample-aligned a + sign * b; the two have equal shapes. One aggregation, no join."""
    both = a.select(*KEY, "x").unionByName(b.select(*KEY, (F.col("x") * sign).alias("x")))
    return both.groupBy(*KEY).agg(F.sum("x").alias("x"))


def total(sources: DataFrame) -> DataFrame:
    """Sum of all sources of an item: the mix."""
    return sources.groupBy(*KEY).agg(F.sum("x").alias("x"))


def gain(signals: DataFrame, value: float) -> DataFrame:
    if isinstance(value, complex):
        raise ValueError("gain is real")
    return signals.withColumn("x", F.col("x") * F.lit(float(value)))


def peak_normalize(signals: DataFrame) -> DataFrame:
    """x over the item's largest magnitude; silence stays silence."""
    peak = F.max(F.abs("x")).over(Window.partitionBy("item"))
    return signals.withColumn("x", F.coalesce(F.try_divide(F.col("x"), peak), F.lit(0.0)))


def to_mono(signals: DataFrame) -> DataFrame:
    return signals.groupBy("item", "n").agg(F.avg("x").alias("x")).select("item", F.lit(0).alias("ch"), "n", "x")


def channel(signals: DataFrame, number: int) -> DataFrame:
    if number < 0:
        raise ValueError("channels count from 0")
    return signals.where(F.col("ch") == number)


def lengths(signals: DataFrame) -> DataFrame:
    return signals.groupBy("item").agg((F.max("n") + 1).alias("length"))


def concat(first: DataFrame, second: DataFrame) -> DataFrame:
    """second after first, by item."""
    after = second.join(lengths(first), "item").select("item", "ch", (F.col("n") + F.col("length")).alias("n"), "x")
    return first.select(*KEY, "x").unionByName(after)


def zero_pad(signals: DataFrame, before: int, after: int) -> DataFrame:
    if before < 0 or after < 0:
        raise ValueError("padding is zero or more")
    ends = signals.groupBy("item", "ch").agg((F.max("n") + 1).alias("length"))
    zeros = lambda first, count: ends.select("item", "ch", F.explode(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: first + k - 1).cast("array<bigint>")).alias("n"), F.lit(0.0).alias("x")) if count else None
    out = signals.select("item", "ch", (F.col("n") + before).alias("n"), "x")
    for more in (zeros(F.lit(0), before), zeros(F.col("length") + before, after)):
        out = out.unionByName(more) if more is not None else out
    return out


def crop(signals: DataFrame, before: int, after: int) -> DataFrame:
    """Without the first and last samples, numbered from 0 again."""
    length = F.max("n").over(Window.partitionBy("item")) + 1
    kept = signals.withColumn("_length", length).where((F.col("n") >= before) & (F.col("n") < F.col("_length") - after))
    return kept.select("item", "ch", (F.col("n") - before).alias("n"), "x")


def truncate(signals: DataFrame, samples: int) -> DataFrame:
    return signals.where(F.col("n") < samples)


def truncate_seconds(signals: DataFrame, seconds: float, rate: int) -> DataFrame:
    return truncate(signals, int(seconds * rate))


def active_region(signals: DataFrame, start: int, end: int) -> DataFrame:
    """A lazy view of [start, end); the filter reaches the scan."""
    return signals.where((F.col("n") >= start) & (F.col("n") < end))


def pan(signals: DataFrame, degrees: float) -> DataFrame:
    """Constant-power stereo of the mono mean; degrees from -45 to 45."""
    if not -45 <= degrees <= 45:
        raise ValueError("angle is between -45 and 45 degrees")
    angle = math.radians(degrees)
    sides = [math.sqrt(0.5) * (math.cos(angle) - math.sin(angle)), math.sqrt(0.5) * (math.cos(angle) + math.sin(angle))]
    gains = F.array(*(F.struct(F.lit(k).alias("ch"), F.lit(g).alias("g")) for k, g in enumerate(sides)))
    return to_mono(signals).select("item", "n", "x", F.explode(gains).alias("s")).select("item", "s.ch", "n", (F.col("x") * F.col("s.g")).alias("x"))


def delay(signals: DataFrame, samples: dict[int, int]) -> DataFrame:
    """Each channel later by its number of samples, zeros first, length kept. One window, whatever the delays."""
    if any(d < 0 for d in samples.values()):
        raise ValueError("delays are zero or more")
    w = Window.partitionBy("item", "ch").orderBy("n")
    x: Column = F.col("x")
    for ch, d in samples.items():
        x = F.when(F.col("ch") == ch, F.lag("x", d, 0.0).over(w) if d else F.col("x")).otherwise(x)
    return signals.withColumn("x", x)


def rms(signals: DataFrame) -> DataFrame:
    return signals.groupBy("item", "ch").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def framed_rms(signals: DataFrame, length: int, hop: int | None = None) -> DataFrame:
    """RMS of centred frames, zeros beyond the ends."""
    hop = hop or length // 2
    half = length // 2
    last = F.floor(F.max("n").over(Window.partitionBy("item")) / F.lit(hop))
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - (length - half) + 1) / F.lit(hop))).cast("bigint")
    final = F.least(last, F.floor((F.col("n") + half) / F.lit(hop))).cast("bigint")
    frames = signals.select("item", "ch", "x", first.alias("a"), final.alias("b")).where("a <= b")
    frames = frames.select("item", "ch", "x", F.explode(F.sequence("a", "b")).alias("t"))
    return frames.groupBy("item", "ch", "t").agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / length).alias("rms"))


def tremolo(signals: DataFrame, rate: int, frequency: float, depth: float) -> DataFrame:
    """Amplitude modulation by a raised sine of the given depth."""
    if not 0.1 <= frequency <= 20000 or not 0 <= depth <= 1:
        raise ValueError("frequency is 0.1 to 20000 Hz, depth 0 to 1")
    swing = F.sin(F.lit(2 * math.pi * frequency / rate) * F.col("n"))
    return signals.withColumn("x", F.col("x") * (1 - F.lit(depth) * (0.5 - swing * 0.5)))


def sum_sources(sources: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Sources whose label (before ::) is in a group become the group's sum; the others stay."""
    claimed = [x for v in groups.values() for x in v]
    if len(claimed) != len(set(claimed)):
        raise KeyError("a source is in two groups")
    prefix = F.split("label", "::")[0]
    name: Column = F.col("label")
    for group, members in groups.items():
        name = F.when(prefix.isin(members), F.lit(group)).otherwise(name)
    return sources.groupBy("item", name.alias("label"), "ch", "n").agg(F.sum("x").alias("x"))


def labels_to_one_hot(sources: DataFrame, categories: list[str]) -> DataFrame:
    """item, one_hot: for each source in label order, where its label stands among the categories."""
    labels = F.array_sort(F.collect_set("label"))
    rows = sources.groupBy("item").agg(labels.alias("labels"))
    known = F.array(*map(F.lit, sorted(categories)))
    return rows.select("item", F.transform("labels", lambda x: F.transform(known, lambda c: (c == F.split(x, "::")[0]).cast("int"))).alias("one_hot"))


def index_source(sources: DataFrame, index: int) -> DataFrame:
    """The source at that place in label order."""
    place = F.dense_rank().over(Window.partitionBy("item").orderBy("label")) - 1
    return sources.withColumn("_k", place).where(F.col("_k") == index).drop("_k")


def excerpt(signals: DataFrame, length: int, offset: Column | int = 0) -> DataFrame:
    """`length` samples from an offset by item; short items are padded with zeros at the end."""
    moved = signals.withColumn("n", F.col("n") - offset).where((F.col("n") >= 0) & (F.col("n") < length)).select(*KEY, "x")
    grid = signals.select("item", "ch").distinct().select("item", "ch", F.explode(F.sequence(F.lit(0), F.lit(length - 1)).cast("array<bigint>")).alias("n"), F.lit(0.0).alias("x"))
    return moved.unionByName(grid).groupBy(*KEY).agg(F.sum("x").alias("x"))


def random_offset(length: Column, excerpt_length: int, seed: int = 0) -> Column:
    """A place by item that depends on the seed and the item alone, so all its signals share it."""
    room = F.greatest(length - excerpt_length, F.lit(0)) + 1
    return F.pmod(F.xxhash64(F.lit(seed), "item"), room)


def collect_windows(signals: DataFrame, window: int, hop: int) -> DataFrame:
    """Chunks (item, chunk, ch, n, x) of the signal padded by hop on both sides; starts are multiples of hop."""
    padded = zero_pad(signals, hop, hop)
    last = F.floor((F.max("n").over(Window.partitionBy("item")) - hop) / F.lit(hop))
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - window + 1) / F.lit(hop))).cast("bigint")
    rows = padded.select(*KEY, "x", first.alias("a"), F.least(last, F.floor(F.col("n") / F.lit(hop))).cast("bigint").alias("b")).where("a <= b")
    return rows.select(*KEY, "x", F.explode(F.sequence("a", "b")).alias("chunk")).select("item", "chunk", "ch", (F.col("n") - F.col("chunk") * hop).alias("n"), "x")


def overlap_and_add(chunks: DataFrame, window: int, hop: int) -> DataFrame:
    """Sum of periodic-Hann-weighted chunks without normalisation, padding taken off."""
    weight = 0.5 - 0.5 * F.cos(F.lit(2 * math.pi / window) * F.col("n"))
    rows = chunks.select("item", "ch", (F.col("n") + F.col("chunk") * hop - hop).alias("n"), (F.col("x") * weight).alias("x"))
    return rows.where("n >= 0").groupBy(*KEY).agg(F.sum("x").alias("x"))


def equal(a: DataFrame, b: DataFrame, digits: int = 9) -> DataFrame:
    """item, equal: whether the two hold the same samples at the same places, rounded; one aggregation, no join."""
    both = a.select(*KEY, F.round("x", digits).alias("x"), F.lit(1).alias("side")).unionByName(b.select(*KEY, F.round("x", digits).alias("x"), F.lit(-1).alias("side")))
    cells = both.groupBy(*KEY, "x").agg(F.sum("side").alias("gap"))
    return cells.groupBy("item").agg((F.max(F.abs("gap")) == 0).alias("equal"))


def divide(signals: DataFrame, value: float) -> DataFrame:
    return gain(signals, 1 / value)
