"""Registered queries of the signal-separation operators, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import effects, kernels, learning, masks, metrics, network, repetition, signal, spatial, spectral
from ..sources import files, views

L, H, BINS = 16, 4, 9
QUERIES: dict = {}
ORACLES: dict = {}


def r4(c, name=None):
    """Rounded to four decimals, without a negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, 4) + F.lit(0.0)).alias(name or c)


def query(sql: str | None = None, *needs: str):
    """Registers a query under its name; needs are the views that its SQL reads."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {', '.join(views.SQL[n] for n in needs)} {sql}" if needs else sql
        return f

    return put


def sig(spark, d):
    return views.event_signals(spark, d)


def src(spark, d):
    return views.event_sources(sig(spark, d), views.EVENT_TYPES)


def rounded(df, *values):
    return df.select(*[r4(c) if c in values else F.col(c) for c in df.columns])


STFT = """, k AS (SELECT unnest(range(16)) k), wk AS (SELECT k, sqrt(greatest(0.0, 0.5 - 0.5 * cos(2 * pi() * k / 16))) w FROM k),
fr AS (SELECT s.*, t, n + 8 - t * 4 k FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((n - 7) / 4.0) AS BIGINT)), least(CAST(ceil(len / 4.0) AS BIGINT), (n + 8) // 4) + 1)) t FROM (SELECT *, max(n) OVER (PARTITION BY item) + 1 len FROM {v})) s),
z AS (SELECT item{l}, ch, t, f, sum(x * w * cos(2 * pi() * ((fr.k * f) % 16) / 16)) / (SELECT sum(w) FROM wk) re, -sum(x * w * sin(2 * pi() * ((fr.k * f) % 16) / 16)) / (SELECT sum(w) FROM wk) im
  FROM fr JOIN wk USING (k), (SELECT unnest(range(9)) f) GROUP BY item{l}, ch, t, f)"""


def stft_sql(view, label=False):
    return STFT.format(v=view, l=", label" if label else "")


def z_query(sql, view="sig", *needs, label=False):
    return query("§" + stft_sql(view, label)[1:] + " " + sql, *needs)


def _fix(name):
    ORACLES[name] = ORACLES[name].replace(" §", ", ")


def spectra(spark, d):
    return spectral.stft(sig(spark, d), L, H)


def source_spectra(spark, d):
    """STFT of every source."""
    return spectral.stft(src(spark, d), L, H, by=("label",))


# Signals

@query("SELECT item, max(n) + 1 AS length, max(ch) + 1 AS channels, (max(n) + 1) / 8000.0::DOUBLE AS duration FROM sig GROUP BY item", "sig")
def signal_shape(spark, d):
    return signal.shape(sig(spark, d), 8000)


@query("SELECT item, n, round(CASE WHEN len > 1 THEN n * (len / 8000.0::DOUBLE) / (len - 1) ELSE 0 END, 12) AS seconds FROM (SELECT item, n, max(n) OVER (PARTITION BY item) + 1 len FROM sig)", "sig")
def time_vector(spark, d):
    return signal.time_vector(signal.shape(sig(spark, d), 8000)).withColumn("seconds", F.round("seconds", 12))


@query("SELECT f, f * 4000 / 8.0::DOUBLE AS hz FROM (SELECT unnest(range(9)) f)")
def freq_vector(spark, d):
    return spark.range(BINS).select(F.col("id").alias("f"), spectral.frequency(F.col("id"), 8000, BINS).alias("hz"))


@query("SELECT item, ch, n, round(sum(x), 4) + 0.0 AS x FROM src WHERE label IN ('error', 'click') GROUP BY ALL", "sig", "src")
def add(spark, d):
    s = src(spark, d)
    return rounded(signal.add(s.where("label = 'error'"), s.where("label = 'click'")), "x")


@query("SELECT item, ch, n, round(CASE WHEN label = 'view' THEN 0 ELSE x END, 4) + 0.0 AS x FROM sig", "sig")
def subtract(spark, d):
    return rounded(signal.add(sig(spark, d), src(spark, d).where("label = 'view'"), -1), "x")


@query("SELECT item, ch, n, round(x * 0.5, 4) + 0.0 AS x FROM sig", "sig")
def gain(spark, d):
    return rounded(signal.gain(sig(spark, d), 0.5).drop("label"), "x")


@query("SELECT item, ch, n, round(x / max(abs(x)) OVER (PARTITION BY item), 4) + 0.0 AS x FROM sig", "sig")
def peak_normalize(spark, d):
    return rounded(signal.peak_normalize(sig(spark, d)).drop("label"), "x")


@query("SELECT item, 0 AS ch, n, round(avg(x), 7) + 0.0 AS x FROM st GROUP BY item, n", "line", "st")
def to_mono(spark, d):
    return signal.to_mono(views.line_stereo(spark, d)).withColumn("x", F.round("x", 7) + 0.0)


@query("SELECT item, ch, n, round(x, 4) AS x FROM sig UNION ALL SELECT item, ch, n + max(n) OVER (PARTITION BY item) + 1, round(2 * x, 4) FROM sig", "sig")
def concat(spark, d):
    s = sig(spark, d)
    return rounded(signal.concat(s, signal.gain(s, 2)), "x")


@query("SELECT item, ch, n + 3 AS n, round(x, 4) AS x FROM sig UNION ALL SELECT item, 0, unnest(range(3)), 0.0 FROM (SELECT DISTINCT item FROM sig) UNION ALL SELECT item, 0, len + 3 + unnest(range(2)), 0.0 FROM (SELECT item, max(n) + 1 len FROM sig GROUP BY item)", "sig")
def zero_pad(spark, d):
    return rounded(signal.zero_pad(sig(spark, d), 3, 2), "x")


@query("SELECT item, ch, n - 5 AS n, round(x, 4) AS x FROM (SELECT *, max(n) OVER (PARTITION BY item) + 1 len FROM sig) WHERE n >= 5 AND n < len - 7", "sig")
def crop(spark, d):
    return rounded(signal.crop(sig(spark, d), 5, 7), "x")


@query("SELECT item, ch, n, round(x, 4) AS x FROM sig WHERE n < 20", "sig")
def truncate(spark, d):
    return rounded(signal.truncate(sig(spark, d), 20).drop("label"), "x")


@query("SELECT item, ch, n, round(x, 4) AS x FROM sig WHERE n >= 10 AND n < 30", "sig")
def active_region(spark, d):
    return rounded(signal.active_region(sig(spark, d), 10, 30).drop("label"), "x")


@query("SELECT item, c AS ch, n, round(x * sqrt(0.5) * (cos(radians(15)) + (2 * c - 1) * sin(radians(15))), 4) + 0.0 AS x FROM sig, (SELECT unnest([0, 1]) c)", "sig")
def pan(spark, d):
    return rounded(signal.pan(sig(spark, d), 15), "x")


@query("SELECT item, ch, n, round(CASE WHEN ch = 0 THEN lag(x, 2, 0.0) OVER w ELSE lag(x, 5, 0.0) OVER w END, 6) + 0.0 AS x FROM st WINDOW w AS (PARTITION BY item, ch ORDER BY n)", "line", "st")
def delay(spark, d):
    return signal.delay(views.line_stereo(spark, d), {0: 2, 1: 5}).withColumn("x", F.round("x", 6) + 0.0)


@query("SELECT item, ch, round(sqrt(avg(x * x)), 4) AS rms FROM st GROUP BY item, ch", "line", "st")
def rms(spark, d):
    return rounded(signal.rms(views.line_stereo(spark, d)), "rms")


@query("SELECT item, ch, t, round(sqrt(sum(x * x) / 8), 4) AS rms FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((n - 3) / 4.0) AS BIGINT)), least(len // 4, (n + 4) // 4) + 1)) t FROM (SELECT *, max(n) OVER (PARTITION BY item) len FROM sig)) GROUP BY item, ch, t", "sig")
def rms_framed(spark, d):
    return rounded(signal.framed_rms(sig(spark, d), 8), "rms")


@query("SELECT item, n, q / 32768.0::DOUBLE AS x FROM line", "line")
def int16_scale(spark, d):
    return views.line_stereo(spark, d).where("ch = 0").select("item", "n", files.from_integers(F.col("x")).alias("x"))


@query("SELECT item, ch, n, round(x * (1 - 0.5 * (0.5 - 0.5 * sin(2 * pi() * 5 / 8000 * n))), 4) + 0.0 AS x FROM sig", "sig")
def tremolo(spark, d):
    return rounded(signal.tremolo(sig(spark, d), 8000, 5, 0.5).drop("label"), "x")


@query("SELECT item, CASE WHEN label IN ('error', 'view') THEN 'buy' ELSE label END AS label, ch, n, round(sum(x), 4) + 0.0 AS x FROM src GROUP BY ALL", "sig", "src")
def sum_sources(spark, d):
    return rounded(signal.sum_sources(src(spark, d), {"buy": ["error", "view"]}), "x")


@query("SELECT item, '0100,0010' AS one_hot FROM (SELECT DISTINCT item FROM src)", "sig", "src")
def labels_to_one_hot(spark, d):
    rows = signal.labels_to_one_hot(src(spark, d).where("label in ('error', 'purchase')"), ["click", "error", "purchase", "view"])
    return rows.select("item", F.array_join(F.transform("one_hot", lambda x: F.array_join(x.cast("array<string>"), "")), ",").alias("one_hot"))


@query("SELECT item, label, ch, n, round(x, 4) + 0.0 AS x FROM src WHERE label = 'error'", "sig", "src")
def index_sources(spark, d):
    return rounded(signal.index_source(src(spark, d), 1), "x")


@query("SELECT item, 0 AS ch, g AS n, round(coalesce(x, 0), 4) AS x FROM (SELECT DISTINCT item FROM sig) CROSS JOIN (SELECT unnest(range(60)) g) LEFT JOIN (SELECT item, n, x FROM sig) s USING (item) WHERE s.n = g + 10 UNION ALL SELECT item, 0, unnest(range(greatest(0, len - 10), 60)), 0.0 FROM (SELECT item, max(n) + 1 len FROM sig GROUP BY item)", "sig")
def get_excerpt_fixed_offset(spark, d):
    return rounded(signal.excerpt(sig(spark, d), 60, 10), "x")


@query("SELECT item, ch, n, round(sum(x), 4) + 0.0 AS x FROM lsrc GROUP BY item, ch, n", "line", "lsrc")
def mix_of_sources(spark, d):
    return rounded(signal.total(views.line_sources(spark, d)), "x")


@query("SELECT item, k AS src, ch, n, round(x, 4) + 0.0 AS x FROM sig, (SELECT unnest([0, 1]) k)", "sig")
def mix_as_estimate(spark, d):
    return rounded(masks.mix_as_estimate(sig(spark, d), 2), "x")


@query("SELECT item, chunk, ch, n, round(x, 4) + 0.0 AS x FROM (SELECT item, c chunk, 0 ch, p - c * 8 n, x FROM (SELECT item, p, x, len, unnest(range(greatest(0, CAST(ceil((p - 15) / 8.0) AS BIGINT)), least((len + 7) // 8, p // 8) + 1)) c FROM (SELECT item, n + 8 p, x, max(n) OVER (PARTITION BY item) + 1 len FROM sig UNION ALL SELECT item, unnest(range(8)), 0.0, len FROM (SELECT item, max(n) + 1 len FROM sig GROUP BY item) UNION ALL SELECT item, len + 8 + unnest(range(8)), 0.0, len FROM (SELECT item, max(n) + 1 len FROM sig GROUP BY item))))", "sig")
def chunk_collect(spark, d):
    return rounded(signal.collect_windows(sig(spark, d), 16, 8), "x")


@query("SELECT item, ch, n, round(x, 4) + 0.0 AS x FROM sig", "sig")
def overlap_add_identity(spark, d):
    s = sig(spark, d)
    chunks = signal.collect_windows(s, 16, 8)
    back = signal.overlap_and_add(chunks, 16, 8).join(signal.lengths(s), "item").where("n < length").drop("length")
    return rounded(back, "x")


# Spectra

@query("SELECT k, round(0.5 - 0.5 * cos(2 * pi() * k / 16), 6) AS hann, round(sqrt(greatest(0, 0.5 - 0.5 * cos(2 * pi() * k / 16))), 6) AS sqrt_hann, round(0.54 - 0.46 * cos(2 * pi() * k / 16), 6) AS hamming FROM (SELECT unnest(range(16)) k)")
def window_vectors(spark, d):
    k = spark.range(16).select(F.col("id").alias("k"))
    return k.select("k", *(F.round(spectral.window_weight(F.col("k"), 16, n), 6).alias(n) for n in ("hann", "sqrt_hann", "hamming")))


@z_query("SELECT item, ch, t, count(*) AS samples, round(sum(x), 4) AS total FROM fr GROUP BY item, ch, t", "sig", "sig")
def frames(spark, d):
    return spectral.frames(sig(spark, d), L, H).groupBy("item", "ch", "t").agg(F.count(F.lit(1)).alias("samples"), r4(F.sum("x"), "total"))


@z_query("SELECT item, ch, t, f, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM z", "sig", "sig")
def stft(spark, d):
    return rounded(spectra(spark, d), "re", "im")


@z_query("SELECT item, ch, t, f, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM z", "sig", "sig")
def stft_packed(spark, d):
    return rounded(spectral.stft_packed(sig(spark, d), L, H), "re", "im")


@z_query("SELECT item, ch, t, f, round(sqrt(re * re + im * im), 4) AS magnitude, round(re * re + im * im, 4) AS power, round(20 * log10(sqrt(re * re + im * im) + 1e-8), 2) AS db FROM z WHERE f = 0", "sig", "sig")
def magnitude_power_log(spark, d):
    z = spectra(spark, d).where("f = 0")
    return z.select("item", "ch", "t", "f", r4(spectral.magnitude(), "magnitude"), r4(spectral.power(), "power"), F.round(spectral.log_magnitude(), 2).alias("db"))


@query("SELECT item, ch, n, round(x, 4) + 0.0 AS x FROM sig", "sig")
def stft_roundtrip(spark, d):
    s = sig(spark, d)
    return rounded(spectral.istft(spectral.stft(s, L, H), signal.lengths(s), L, H), "x")


@z_query("SELECT a.item, a.t, a.f, round(20 * log10(sqrt(a.re * a.re + a.im * a.im) / (sqrt(b.re * b.re + b.im * b.im) + 1e-4) + 1e-8), 3) + 0.0 AS ild FROM z a JOIN z b ON a.item = b.item AND a.t = b.t AND a.f = b.f AND a.ch = 0 AND b.ch = 1 WHERE a.f BETWEEN 1 AND 7", "st", "line", "st")
def ipd_ild(spark, d):
    z = spectral.stft(views.line_stereo(spark, d), L, H)
    return spectral.ipd_ild(z).where("f between 1 and 7").select("item", "t", "f", (F.round("ild", 3) + 0.0).alias("ild"))


@z_query("SELECT item, count(*) AS loud FROM (SELECT item, round(sqrt(re * re + im * im), 9) m FROM z) JOIN (SELECT item, quantile_cont(round(sqrt(re * re + im * im), 9), 0.95) c FROM z GROUP BY item) USING (item) WHERE m > c GROUP BY item", "sig", "sig")
def loud_bins(spark, d):
    return spectral.loud_bins(spectra(spark, d)).groupBy("item").agg(F.count(F.lit(1)).alias("loud"))


# Masks

SM = ", m AS (SELECT *, round(sqrt(re * re + im * im), 9) g FROM z)"
IBM = SM + ", ibm AS (SELECT item, label src, ch, t, f, CASE WHEN g = max(g) OVER c AND sum(CASE WHEN g = top THEN 1 ELSE 0 END) OVER c = 1 THEN 1.0 ELSE 0.0 END m, re, im FROM (SELECT *, max(g) OVER (PARTITION BY item, ch, t, f) top FROM m) WINDOW c AS (PARTITION BY item, ch, t, f))"


@z_query(IBM[1:] and f"§§{IBM} SELECT item, src, ch, t, f, m FROM ibm", "src", "sig", "src", label=True)
def ideal_binary_mask(spark, d):
    return masks.ideal_binary(source_spectra(spark, d))


@z_query("SELECT item, label AS src, ch, t, f, round(sqrt(re * re + im * im) / (sum(sqrt(re * re + im * im)) OVER (PARTITION BY item, ch, t, f) + 1e-8), 4) + 0.0 AS m FROM z", "src", "sig", "src", label=True)
def irm_msa(spark, d):
    return rounded(masks.ideal_ratio(source_spectra(spark, d)), "m")


@z_query("§§, x AS (SELECT *, sum(re) OVER c xr, sum(im) OVER c xi FROM z WINDOW c AS (PARTITION BY item, ch, t, f)), s AS (SELECT *, sqrt(xr * xr + xi * xi) xm FROM x), p AS (SELECT *, least(greatest((re * xr + im * xi) / xm, 0), xm) a FROM s WHERE xm > 1e-6) SELECT item, label AS src, ch, t, f, round(a / (sum(a) OVER (PARTITION BY item, ch, t, f) + 1e-8), 3) + 0.0 AS m FROM p", "src", "sig", "src", label=True)
def irm_psa(spark, d):
    z = masks.beside_mix(source_spectra(spark, d)).where(spectral.magnitude("xr", "xi") > 1e-6)
    return masks.ideal_ratio(z).withColumn("m", F.round("m", 3) + 0.0)


@z_query(f"§§{IBM} SELECT src, sum(1 - m) AS off, sum(CASE WHEN m > 0.5 THEN 1 ELSE 0 END)::BIGINT AS lit FROM ibm GROUP BY src", "src", "sig", "src", label=True)
def mask_invert_threshold(spark, d):
    m = masks.ideal_binary(source_spectra(spark, d))
    return m.groupBy("src").agg(F.sum(masks.invert(F.col("m"))).alias("off"), F.sum(masks.to_binary(F.col("m"))).alias("lit"))


@z_query(f"§§{IBM} SELECT item, src, ch, round(sum(zr * m), 3) + 0.0 AS re, round(sum(zi * m), 3) + 0.0 AS im FROM ibm JOIN (SELECT item, ch, t, f, sum(re) zr, sum(im) zi FROM z GROUP BY ALL) USING (item, ch, t, f) GROUP BY item, src, ch", "src", "sig", "src", label=True)
def apply_mask(spark, d):
    out = masks.apply(spectra(spark, d), masks.ideal_binary(source_spectra(spark, d)))
    return out.groupBy("item", "src", "ch").agg((F.round(F.sum("re"), 3) + 0.0).alias("re"), (F.round(F.sum("im"), 3) + 0.0).alias("im"))


@query("SELECT f, CASE WHEN f < 2 THEN 1.0 ELSE 0.0 END AS low, CASE WHEN f < 2 THEN 0.0 ELSE 1.0 END AS high FROM (SELECT unnest(range(9)) f)")
def high_low_pass(spark, d):
    _, low, high = masks.high_low_pass(BINS, 8000, 1100)
    return spark.range(BINS).select(F.col("id").alias("f")).select("f", low.alias("low"), high.alias("high"))


@z_query("SELECT item, ch, t, f, round(sqrt(g / (sum(g) OVER w + 1e-6) * (max(t) OVER w + 1) * (max(f) OVER w + 1)), 4) AS weight FROM (SELECT *, sqrt(re * re + im * im) g FROM z) WINDOW w AS (PARTITION BY item)", "sig", "sig")
def magnitude_weights(spark, d):
    return rounded(masks.magnitude_weights(spectra(spark, d)), "weight")


# Metrics

GRAM = """, mx AS (SELECT *, sum(x) OVER (PARTITION BY item, ch, n) m FROM lsrc), es AS (SELECT item, label est, ch, n, 0.8 * x + 0.1 * m e FROM mx),
pr AS (SELECT mx.item, mx.ch, label ref, est, count(*) k, sum(x) s, sum(e) e_, sum(m) m_, sum(x * x) ss, sum(e * e) ee, sum(x * e) se, sum(m * m) mm, sum(m * x) ms FROM mx JOIN es USING (item, ch, n) GROUP BY ALL),
gr AS (SELECT item, ch, ref, est, ss - s * s / k ss, ee - e_ * e_ / k ee, se - s * e_ / k se, mm - m_ * m_ / k mm, ms - m_ * s / k ms FROM pr),
al AS (SELECT *, se / ss a, ms / ss b FROM gr),
sc AS (SELECT item, ch, ref, est, 10 * log10(a * a * ss / (ee - 2 * a * se + a * a * ss)) si_sdr, 10 * log10(ss / (ee - 2 * se + ss)) snr, -10 * log10((1 - 1 / a) ** 2) srr, 10 * log10(ss / (ee - 2 * se + ss)) + 10 * log10(a * a) sd_sdr,
  10 * log10(a * a * ss / (ee - 2 * a * se + a * a * ss)) - 10 * log10(b * b * ss / (mm - 2 * b * ms + b * b * ss)) si_sdri, 10 * log10(ss / (ee - 2 * se + ss)) - 10 * log10(ss / (mm - 2 * ms + ss)) snri FROM al)"""


def line_estimates(spark, d):
    s = views.line_sources(spark, d)
    mix = F.sum("x").over(Window.partitionBy("item", "ch", "n"))
    return s, s.select("item", "label", "ch", "n", (0.8 * F.col("x") + 0.1 * mix).alias("x"))


@query(f"§{GRAM} SELECT item, ch, ref, est, round(si_sdr, 3) + 0.0 AS si_sdr, round(snr, 3) + 0.0 AS snr, round(srr, 3) + 0.0 AS srr, round(sd_sdr, 3) + 0.0 AS sd_sdr, round(si_sdri, 3) + 0.0 AS si_sdri, round(snri, 3) + 0.0 AS snri FROM sc WHERE ref = est", "line", "lsrc")
def si_metrics(spark, d):
    s, e = line_estimates(spark, d)
    got = metrics.si_metrics(metrics.gram(s, e)).where("ref = est")
    return got.select("item", "ch", "ref", "est", *((F.round(c, 3) + 0.0).alias(c) for c in ("si_sdr", "snr", "srr", "sd_sdr", "si_sdri", "snri")))


@query(f"§{GRAM} SELECT item, 'a,b,c' AS \"order\", round(avg(si_sdr), 3) + 0.0 AS mean FROM sc WHERE ref = est GROUP BY item", "line", "lsrc")
def permutation_search(spark, d):
    s, e = line_estimates(spark, d)
    return metrics.best_permutation(metrics.si_metrics(metrics.gram(s, e)), ["a", "b", "c"]).select("item", "order", (F.round("mean", 3) + 0.0).alias("mean"))


@query("""§, m AS (SELECT item, n, q p, d o, 0.9 * q + 0.2 * d + 0.05 * t e1, 0.8 * d + 0.1 * q + 0.05 * t e2 FROM line),
e AS (SELECT item, 'a' est, p s, o r, e1 e FROM m UNION ALL SELECT item, 'b', o, p, e2 FROM m),
g AS (SELECT item, est, sum(s * s) - sum(s) * sum(s) / count(*) ss, sum(r * r) - sum(r) * sum(r) / count(*) oo, sum(s * r) - sum(s) * sum(r) / count(*) so, sum(s * e) - sum(s) * sum(e) / count(*) se, sum(r * e) - sum(r) * sum(e) / count(*) oe, sum(e * e) - sum(e) * sum(e) / count(*) ee FROM e GROUP BY ALL),
h AS (SELECT *, se / ss al, ss * (oe - se / ss * so) ** 2 / (ss * oo - so * so) i FROM g)
SELECT item, 0 AS ch, est, round(10 * log10(al * al * ss / i), 3) + 0.0 AS si_sir, round(10 * log10(al * al * ss / (ee - al * se - i)), 3) + 0.0 AS si_sar FROM h""", "line")
def si_sir_sar(spark, d):
    s = views.line_sources(spark, d)
    wide = s.groupBy("item", "ch", "n").agg(*(F.max(F.when(F.col("label") == v, F.col("x"))).alias(v) for v in "abc"))
    mixed = F.array(F.struct(F.lit("a").alias("label"), (0.9 * F.col("a") + 0.2 * F.col("b") + 0.05 * F.col("c")).alias("x")), F.struct(F.lit("b").alias("label"), (0.8 * F.col("b") + 0.1 * F.col("a") + 0.05 * F.col("c")).alias("x")))
    e = wide.select("item", "ch", "n", F.explode(mixed).alias("s")).select("item", "s.label", "ch", "n", "s.x")
    return metrics.si_sir_sar(s.where("label in ('a', 'b')"), e, ("a", "b")).select("item", "ch", "est", (F.round("si_sir", 3) + 0.0).alias("si_sir"), (F.round("si_sar", 3) + 0.0).alias("si_sar"))


@query("SELECT round(avg((quality = toxic)::INT), 6) AS accuracy, round(sum((quality = 1 AND toxic = 1)::INT) / sum((toxic = 1)::INT), 6) AS precision, round(sum((quality = 1 AND toxic = 1)::INT) / sum((quality = 1)::INT), 6) AS recall, round(2 * sum((quality = 1 AND toxic = 1)::INT) / (sum((quality = 1)::INT) + sum((toxic = 1)::INT)), 6) AS f1 FROM labels")
def precision_recall_f1(spark, d):
    got = metrics.precision_recall(views.table(spark, d, "labels"), "quality", "toxic")
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


FRAME = "§, s AS (SELECT label source, item file, sqrt(avg(x * x)) rms, max(abs(x)) peak FROM src GROUP BY ALL)"


def score_frame(spark, d):
    return src(spark, d).groupBy(F.col("label").alias("source"), F.col("item").alias("file")).agg(F.sqrt(F.avg(F.col("x") ** 2)).alias("rms"), F.max(F.abs("x")).alias("peak"))


@query(FRAME + " SELECT source, file, round(rms, 4) AS rms, round(peak, 4) AS peak FROM s", "sig", "src")
def aggregate_scores(spark, d):
    f = score_frame(spark, d)
    long = f.select("source", "file", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("rms", "peak")))).alias("s")).select("source", "file", "s.*")
    return rounded(metrics.aggregate_scores(long, ["rms", "peak"]), "rms", "peak")


@query(FRAME + " SELECT coalesce(source, 'OVERALL') AS source, count(*) AS n, floor(avg(peak) * 100) / 100 AS peak_mean, floor(stddev_samp(peak) * 100) / 100 AS peak_std, floor(median(peak) * 100) / 100 AS peak_median FROM s GROUP BY ROLLUP (source)", "sig", "src")
def report_card(spark, d):
    return metrics.report_card(score_frame(spark, d), ["peak"])


@query(FRAME + " SELECT 'rms' AS metric, round(avg(rms), 4) AS mean, round(median(rms), 4) AS median, round(stddev_pop(rms), 4) AS std FROM s UNION ALL SELECT 'peak', round(avg(peak), 4), round(median(peak), 4), round(stddev_pop(peak), 4) FROM s", "sig", "src")
def associate_metrics(spark, d):
    return rounded(metrics.associate_metrics(score_frame(spark, d), ["rms", "peak"]), "mean", "median", "std")


# Repetition

BEAT = "§§, p AS (SELECT item, ch, t, f, re * re + im * im p FROM z), b AS (SELECT a.item, a.ch, b.t - a.t lag, a.f, sum(a.p * b.p) / count(*) v FROM p a JOIN p b ON a.item = b.item AND a.ch = b.ch AND a.f = b.f AND b.t >= a.t GROUP BY ALL), bs AS (SELECT item, ch, lag, avg(v) v FROM b GROUP BY ALL)"


@z_query(BEAT + " SELECT item, ch, lag::INT AS lag, round(v, 2) AS v FROM bs", "sig", "sig")
def beat_spectrum(spark, d):
    return repetition.beat_spectrum(spectra(spark, d)).withColumn("v", F.round("v", 2))


PERIOD = BEAT + ", pd AS (SELECT item, ch, arg_max(lag, struct_pack(v := round(v, 9), l := -lag)) period FROM bs WHERE lag BETWEEN 2 AND 6 GROUP BY ALL)"


@z_query(PERIOD + " SELECT item, ch, period::INT AS period FROM pd", "sig", "sig")
def repeating_period(spark, d):
    return repetition.repeating_period(repetition.beat_spectrum(spectra(spark, d)), 2, 6)


@z_query(PERIOD + ", g AS (SELECT z.item, z.ch, t, f, sqrt(re * re + im * im) m, period FROM z JOIN pd USING (item, ch)) SELECT item, ch, t, f, round((least(m, median(m) OVER (PARTITION BY item, ch, f, t % period)) + 1e-16) / (m + 1e-16), 3) AS m FROM g WHERE f BETWEEN 1 AND 7", "sig", "sig")
def repet_mask(spark, d):
    z = spectra(spark, d)
    got = repetition.repeating_mask(z, repetition.repeating_period(repetition.beat_spectrum(z), 2, 6))
    return got.where("f between 1 and 7").withColumn("m", F.round("m", 3))


SIM = "§§, m AS (SELECT item, t, f, avg(sqrt(re * re + im * im)) m FROM z GROUP BY ALL), nn AS (SELECT item, t, sqrt(sum(m * m)) n FROM m GROUP BY ALL), s AS (SELECT a.item, a.t i, b.t j, sum(a.m * b.m) / any_value(x.n * y.n) s FROM m a JOIN m b USING (item, f) JOIN nn x ON x.item = a.item AND x.t = a.t JOIN nn y ON y.item = b.item AND y.t = b.t GROUP BY ALL)"


@z_query(SIM + " SELECT item, i, j, round(s, 4) AS s FROM s", "sig", "sig")
def similarity_matrix(spark, d):
    return rounded(repetition.similarity_matrix(spectra(spark, d)), "s")


@z_query(SIM + " SELECT item, i, j, rank FROM (SELECT item, i, j, row_number() OVER (PARTITION BY item, i ORDER BY round(s, 9) DESC, j) rank FROM s WHERE i <> j AND s >= 0) WHERE rank <= 3", "sig", "sig")
def top_similar(spark, d):
    return repetition.top_similar(repetition.similarity_matrix(spectra(spark, d)), 3)


@z_query("§§, g AS (SELECT *, sqrt(re * re + im * im) m FROM z), h AS (SELECT item, ch, t, f, quantile_cont(m, 0.5) OVER (PARTITION BY item, ch, f ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) h, quantile_cont(m, 0.5) OVER (PARTITION BY item, ch, t ORDER BY f ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) p FROM g) SELECT item, ch, t, f, round(h * h / (h * h + p * p), 3) AS harmonic, round(p * p / (h * h + p * p), 3) AS percussive FROM h", "sig", "sig")
def hpss_median(spark, d):
    return repetition.hpss(spectra(spark, d), 5).select("item", "ch", "t", "f", F.round("harmonic", 3).alias("harmonic"), F.round("percussive", 3).alias("percussive"))


# Stereo

AD = "§§, pr AS (SELECT a.item, a.t, a.f, a.re + 1e-16 ar, a.im ai, b.re + 1e-16 br, b.im bi, sqrt(a.re * a.re + a.im * a.im) * sqrt(b.re * b.re + b.im * b.im) w FROM z a JOIN z b ON a.item = b.item AND a.t = b.t AND a.f = b.f AND a.ch = 0 AND b.ch = 1 WHERE a.f > 0), q AS (SELECT item, t, f, w, (br * ar + bi * ai) / (ar * ar + ai * ai) rr, (bi * ar - br * ai) / (ar * ar + ai * ai) ri FROM pr), c AS (SELECT item, t, f, w, sqrt(rr * rr + ri * ri) - 1 / sqrt(rr * rr + ri * ri) a, -atan2(ri, rr) / (2 * pi() * f * 2 * pi() / 16) d FROM q)"


@z_query(AD + " SELECT item, t, f, round(a, 3) + 0.0 AS a, round(w, 3) AS w FROM c WHERE f BETWEEN 1 AND 7", "st", "line", "st")
def duet_attenuation(spark, d):
    c = spatial.attenuation_delay(spectral.stft(views.line_stereo(spark, d), L, H), 8000, L)
    return c.where("f between 1 and 7").select("item", "t", "f", (F.round("a", 3) + 0.0).alias("a"), F.round("w", 3).alias("w"))


@z_query(AD + " SELECT item, count(*) AS cells, sum(CASE WHEN round(a * a, 9) <= round((a - 2) * (a - 2), 9) THEN 0 ELSE 1 END)::BIGINT AS second FROM c WHERE f BETWEEN 1 AND 7 GROUP BY item", "st", "line", "st")
def duet_masks_fixed_peaks(spark, d):
    c = spatial.attenuation_delay(spectral.stft(views.line_stereo(spark, d), L, H), 8000, L).where("f between 1 and 7").withColumn("d", F.lit(0.0))
    return spatial.peak_masks(c, [(0.0, 0.0), (2.0, 0.0)]).groupBy("item").agg(F.count(F.lit(1)).alias("cells"), F.sum("src").alias("second"))


@z_query(AD + ", h AS (SELECT item, sum(w) h FROM c WHERE abs(a) < 3 AND abs(d) < 3 AND f BETWEEN 1 AND 7 GROUP BY item, floor((a + 3) * 50 / 6)) SELECT item, round(max(h), 2) AS top FROM h GROUP BY item", "st", "line", "st")
def duet_histogram(spark, d):
    c = spatial.attenuation_delay(spectral.stft(views.line_stereo(spark, d), L, H), 8000, L).where("f between 1 and 7")
    inside = c.where("abs(a) < 3 and abs(d) < 3").withColumn("d", F.lit(0.0))
    tops = spatial.histogram(inside).groupBy("item").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    return tops.select("item", F.round(F.col("w") * F.col("h"), 2).alias("top"))


@z_query(", b AS (SELECT a.item, a.t, a.f, a.re ar, a.im ai, b.re br, b.im bi FROM z a JOIN z b ON a.item = b.item AND a.t = b.t AND a.f = b.f AND a.ch = 0 AND b.ch = 1), g AS (SELECT k, a, d FROM (VALUES (0, 0.5::DOUBLE, 1.0::DOUBLE), (1, 2.0::DOUBLE, -0.5::DOUBLE), (2, 1.0::DOUBLE, 0.0::DOUBLE)) v(k, a, d)), s AS (SELECT item, t, f, k, round((pow(a * (cos(w) * ar + sin(w) * ai) - br, 2) + pow(a * (cos(w) * ai - sin(w) * ar) - bi, 2)) / (1 + a * a), 9) s FROM (SELECT *, f * 2 * pi() * d / 16 w FROM b, g)) SELECT item, k AS src, count(*) AS cells FROM (SELECT item, k, row_number() OVER (PARTITION BY item, t, f ORDER BY round(s, 6), k) r FROM s) WHERE r = 1 GROUP BY item, k", "st", "line", "st")
def duet_masks(spark, d):
    m = spatial.likelihood_masks(spectral.stft(views.line_stereo(spark, d), L, H), [(0.5, 1.0), (2.0, -0.5), (1.0, 0.0)], L)
    return m.groupBy("item", "src").agg(F.count(F.lit(1)).alias("cells"))


# Effects, arithmetic and equality

@query("SELECT item, ch, n, round(x - 0.95 * coalesce(lag(x) OVER (PARTITION BY item ORDER BY n), 0), 4) + 0.0 AS x FROM sig", "sig")
def emphasis(spark, d):
    return rounded(effects.emphasis(sig(spark, d)), "x")


@query("SELECT item, ch, n, round(x + 0.4 * coalesce(lag(x, 3) OVER w, 0) + 0.2 * coalesce(lag(x, 5) OVER w, 0), 4) + 0.0 AS x FROM sig WINDOW w AS (PARTITION BY item ORDER BY n)", "sig")
def echo(spark, d):
    return rounded(effects.echo(sig(spark, d), [3, 5], [0.4, 0.2]), "x")


_DELAYED = "WITH_, l AS (SELECT *, floor(late) k FROM (SELECT *, round({least} + {depth} * (1 + sin(2 * pi() * {hz} / 8000 * n)) / 2, 9) late FROM sig)) SELECT l.item, l.ch, l.n, round({dry} * l.x + {wet} * ((1 - (late - k)) * coalesce(a.x, 0) + (late - k) * coalesce(b.x, 0)), 4) + 0.0 AS x FROM l LEFT JOIN sig a ON a.item = l.item AND a.n = l.n - k LEFT JOIN sig b ON b.item = l.item AND b.n = l.n - k - 1"


def _delayed_sql(**values):
    return _DELAYED.removeprefix("WITH_").format(**values)


@query("§" + _delayed_sql(least=0.0, depth=4.0, hz=300, dry=0.0, wet=1.0), "sig")
def vibrato(spark, d):
    return rounded(effects.modulated_delay(sig(spark, d), 8000, 0.0, 4.0, 300), "x")


@query("§" + _delayed_sql(least=6.0, depth=2.0, hz=200, dry=0.7, wet=0.5), "sig")
def chorus(spark, d):
    return rounded(effects.modulated_delay(sig(spark, d), 8000, 6.0, 2.0, 200, 0.7, 0.5), "x")


@query("§" + _delayed_sql(least=1.0, depth=3.0, hz=100, dry=1.0, wet=0.7), "sig")
def flanger(spark, d):
    return rounded(effects.modulated_delay(sig(spark, d), 8000, 1.0, 3.0, 100, 1.0, 0.7), "x")


@query("SELECT item, ch, n, round(CASE WHEN abs(x) > 50 THEN sign(x) * (50 + (abs(x) - 50) / 5) ELSE x END, 4) + 0.0 AS x FROM sig", "sig")
def compressor(spark, d):
    return rounded(effects.compress(sig(spark, d), 50.0, 5.0).select("item", "ch", "n", "x"), "x")


@query("SELECT item, ch, n, round(x / 4, 4) + 0.0 AS x FROM sig", "sig")
def scalar_divide(spark, d):
    return rounded(signal.divide(sig(spark, d), 4.0).select("item", "ch", "n", "x"), "x")


@query("SELECT item, bool_and(label <> 'view' OR round(x, 9) = 0) AS equal FROM sig GROUP BY item", "sig")
def signal_equality(spark, d):
    s = sig(spark, d)
    return signal.equal(s, s.withColumn("x", F.when(F.col("label") == "view", 0.0).otherwise(F.col("x"))))


@z_query(f"§§{IBM} SELECT item, sum(m) AS total, count(*) AS cells FROM (SELECT item, src, ch, t, f, m + 2.0 AS m FROM ibm) GROUP BY item", "src", "sig", "src", label=True)
def mask_sum(spark, d):
    m = masks.ideal_binary(source_spectra(spark, d))
    both = masks.combine(m, m.withColumn("m", F.lit(1.0)), 2.0)
    return both.groupBy("item").agg(F.sum("m").alias("total"), F.count(F.lit(1)).alias("cells"))


@z_query(f"§§{IBM} SELECT src, sum(CASE WHEN m > 0 THEN 1 ELSE 0 END)::BIGINT AS lit FROM ibm GROUP BY src", "src", "sig", "src", label=True)
def mask_validated(spark, d):
    m = masks.ideal_binary(source_spectra(spark, d))
    return m.groupBy("src").agg(F.sum(masks.validated_binary(F.col("m"))).alias("lit"))


@z_query("SELECT item, count(*)::DOUBLE AS total FROM z GROUP BY item", "sig", "sig")
def mask_ones(spark, d):
    return masks.ones(spectra(spark, d)).groupBy("item").agg(F.sum("m").alias("total"))


def separate_wiener(spark, d):
    """Wiener estimates of three sources, begun from their own magnitudes."""
    return kernels.separate_wiener(views.line_sources(spark, d), L, H)


QUERIES["separate_wiener"] = separate_wiener


# Features and losses

def features(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))


def centres(k=3, size=64):
    return [[0.1 if (i % k) == c else -0.05 for i in range(size)] for c in range(k)]


EMB = "f AS (SELECT vec_id id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings), ct AS (SELECT c, list_transform(range(64), lambda i: CASE WHEN i % 3 = c THEN 0.1 ELSE -0.05 END) m FROM (SELECT unnest(range(3)) c)), ds AS (SELECT id, label, c, list_distance(v, CAST(m AS DOUBLE[])) d FROM f, ct)"


@query(f"WITH {EMB} SELECT id, c, round((exp(-5 * d) + 1e-8) / sum(exp(-5 * d) + 1e-8) OVER (PARTITION BY id), 4) AS r FROM ds")
def kmeans_responsibilities_fixed(spark, d):
    got = learning.responsibilities(features(spark, d), centres())
    return got.select("id", F.posexplode("r").alias("c", "r")).select("id", F.col("c").cast("bigint").alias("c"), r4("r"))


@query(f"WITH {EMB} SELECT round(avg((3 * m - 1) / 2), 6) AS confidence FROM (SELECT id, max(exp(-d)) / sum(exp(-d)) m FROM ds GROUP BY id)")
def posterior_confidence_fixed(spark, d):
    return learning.posterior_confidence(features(spark, d), centres()).select(F.round("confidence", 6).alias("confidence"))


@query(f"WITH {EMB}, n AS (SELECT id, arg_min(c, struct_pack(d := round(d, 9), c := c)) c FROM ds GROUP BY id), k AS (SELECT c, count(*) n FROM n GROUP BY c) SELECT round(CASE WHEN count(*) = 3 THEN min(n) ELSE 0 END / sum(n), 6) AS confidence FROM k")
def loudness_share(spark, d):
    return learning.smallest_share(features(spark, d), centres()).select(F.round("confidence", 6).alias("confidence"))


@query("WITH f AS (SELECT vec_id id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings), p AS (SELECT a.id, a.label la, b.label lb, avg(list_distance(a.v, b.v)) d FROM f a JOIN f b ON a.id <> b.id WHERE a.id % 100 = 0 GROUP BY ALL), s AS (SELECT id, la, max(CASE WHEN la = lb THEN d END) a, min(CASE WHEN la <> lb THEN d END) b FROM p GROUP BY ALL) SELECT id, la AS label, round(coalesce((b - a) / greatest(a, b), 0), 4) + 0.0 AS s FROM s")
def silhouette_fixed_labels(spark, d):
    f = features(spark, d)
    return rounded(learning.silhouette(f, f.where("id % 100 = 0")), "s")


@query("WITH f AS (SELECT vec_id id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings), e AS (SELECT id, label, v, generate_subscripts(v, 1) i FROM f), c AS (SELECT id, label, i, v[i] x FROM e), vv AS (SELECT sum(s * s) t FROM (SELECT a.i, b.i j, sum(a.x * b.x) s FROM c a JOIN c b USING (id) GROUP BY ALL)), vy AS (SELECT sum(s * s) t FROM (SELECT label, i, sum(x) s FROM c GROUP BY ALL)), yy AS (SELECT sum(n * n) t FROM (SELECT label, count(*)::DOUBLE n FROM f GROUP BY label)) SELECT round((vv.t - 2 * vy.t + yy.t) / (SELECT count(*)::DOUBLE ** 2 FROM f), 6) AS loss FROM vv, vy, yy")
def dpcl_loss(spark, d):
    return learning.affinity_loss(features(spark, d)).select(F.round("loss", 6).alias("loss"))


@query("SELECT item, round(avg(abs(0.5 * q - d)), 4) AS l1, round(avg((0.5 * q - d) ** 2), 4) AS mse, round(avg(CASE WHEN d > 0 AND q > 0 THEN d * ln(d / (0.5 * q)) ELSE 0 END), 4) + 0.0 AS kl FROM line GROUP BY item", "line")
def l1_mse_kl(spark, d):
    s = views.line_sources(spark, d).groupBy("item", "n").agg((0.5 * F.max(F.when(F.col("label") == "a", F.col("x")))).alias("e"), F.max(F.when(F.col("label") == "b", F.col("x"))).alias("t"))
    return rounded(learning.regression_losses(s, "e", "t", "item"), "l1", "mse", "kl")


@query("SELECT item, n, round((q - avg(q) OVER w) / sqrt(var_pop(q) OVER w + 1e-5), 4) + 0.0 AS x FROM line WINDOW w AS (PARTITION BY item)", "line")
def instance_norm(spark, d):
    s = views.line_stereo(spark, d).where("ch = 0").select("item", "n", "x")
    return rounded(learning.layer_norm(s, "x", ["item"]).select("item", "n", "x"), "x")


# Networks

@z_query("SELECT item, ch, t, f, round(10 * log10(greatest(re * re + im * im, 1e-8)) - 1, 3) + 0.0 AS db FROM z WHERE f BETWEEN 1 AND 7", "sig", "sig")
def amplitude_to_db(spark, d):
    z = spectra(spark, d).where("f between 1 and 7")
    return z.select("item", "ch", "t", "f", (F.round(network.amplitude_to_db(spectral.magnitude()), 3) + 0.0).alias("db"))


@z_query("§§, ed AS (SELECT k, CASE WHEN m < 15 THEN m * 200 / 3 ELSE 1000 * exp((m - 15) * ln(6.4) / 27) END hz FROM (SELECT k, (15 + ln(4.0) * 27 / ln(6.4)) * k / 5 m FROM (SELECT unnest(range(6)) k))), tw AS (SELECT f, a.k mel, greatest(0, least((f * 500 - a.hz) / (b.hz - a.hz), (c.hz - f * 500) / (c.hz - b.hz))) w FROM ed a JOIN ed b ON b.k = a.k + 1 JOIN ed c ON c.k = a.k + 2, (SELECT unnest(range(9)) f)), mw AS (SELECT f, mel, w / sum(w) OVER (PARTITION BY mel) w FROM tw) SELECT item, ch, t, mel::INT AS mel, round(sum(sqrt(re * re + im * im) * w), 3) + 0.0 AS v FROM z JOIN mw USING (f) GROUP BY item, ch, t, mel", "sig", "sig")
def mel_projection(spark, d):
    z = spectra(spark, d).select("item", "ch", "t", "f", spectral.magnitude().alias("g"))
    return network.mel_projection(z, "g", 8000, BINS, 4).withColumn("v", F.round("v", 3) + 0.0)


@query(f"§{GRAM} SELECT item, round(avg(-10 * log10(10 ** (si_sdr / 10) + 1e-8)), 3) + 0.0 AS loss FROM sc WHERE ref = est GROUP BY item", "line", "lsrc")
def si_sdr_loss(spark, d):
    s, e = line_estimates(spark, d)
    return network.si_sdr_loss(metrics.si_metrics(metrics.gram(s, e)).where("ref = est")).withColumn("loss", F.round("loss", 3) + 0.0)


PAIRS = "§, e AS (SELECT item, q, d, t, 0.9 * q + 0.1 * d + 0.1 * t a, 0.1 * q + 0.9 * d + 0.1 * t b, 0.1 * q + 0.1 * d + 0.9 * t c FROM line), p AS (SELECT item, avg(abs(a - q)) aq, avg(abs(a - d)) ad, avg(abs(a - t)) a_t, avg(abs(b - q)) bq, avg(abs(b - d)) bd, avg(abs(b - t)) b_t, avg(abs(c - q)) cq, avg(abs(c - d)) cd, avg(abs(c - t)) c_t FROM e GROUP BY item)"


@query(PAIRS + " SELECT item, round(least(aq + bd + c_t, aq + cd + b_t, bq + ad + c_t, bq + cd + a_t, cq + ad + b_t, cq + bd + a_t) / 3, 3) AS loss FROM p", "line")
def pit_loss(spark, d):
    s, e = line_estimates(spark, d)
    return network.invariant_loss(s, e, ["a", "b", "c"], ["c", "a", "b"]).withColumn("loss", F.round("loss", 3))


@query(PAIRS + " SELECT item, round(least(aq + bd, aq + cd, bq + ad, bq + cd, cq + ad, cq + bd) / 2, 3) AS loss FROM p", "line")
def cit_loss(spark, d):
    s, e = line_estimates(spark, d)
    return network.invariant_loss(s.where("label in ('a', 'b')"), e, ["a", "b"], ["c", "a", "b"]).withColumn("loss", F.round("loss", 3))


# Files

@query("WITH h AS (SELECT source directory, sha256(text) file_hash FROM documents) SELECT directory, sha256(string_agg(file_hash, '' ORDER BY file_hash)) AS directory_hash FROM h GROUP BY directory")
def directory_hash(spark, d):
    rows = views.table(spark, d, "documents").select(F.col("source").alias("directory"), F.col("text").alias("content"))
    return files.directory_hash(files.file_hashes(rows))


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS name FROM pages")
def basename(spark, d):
    return views.table(spark, d, "pages").select("page_id", files.basename("url").alias("name"))


for _name in list(ORACLES):
    sql = ORACLES[_name]
    for mark in ("§§, ", "§§,", "§, ", "§,"):
        sql = sql.replace(" " + mark, ", ").replace(mark, ", ")
    ORACLES[_name] = sql.replace(" §", ", ")


def flagship(spark, sf_dir):
    """Separation metrics of estimates against true sources, from one pass of products."""
    return si_metrics(spark, sf_dir)


def _separated(method):
    def run(spark, d):
        return kernels.separate(sig(spark, d).drop("label"), method, 8000, L, H)

    return run


for _name in ("rpca", "ft2d", "nmf"):
    QUERIES[f"separate_{_name}"] = _separated(_name)


def separate_ica(spark, d):
    """Independent components of the two channels."""
    return kernels.by_item(views.line_stereo(spark, d), kernels.fast_ica)


def low_pass(spark, d):
    return kernels.by_item(sig(spark, d).drop("label"), lambda x: kernels.by_channel(x, kernels.biquad, 8000, "low", 1000))


def high_pass(spark, d):
    return kernels.by_item(sig(spark, d).drop("label"), lambda x: kernels.by_channel(x, kernels.biquad, 8000, "high", 1000))


def resample(spark, d):
    return kernels.by_item(sig(spark, d).drop("label"), lambda x: kernels.by_channel(x, kernels.resample, 8000, 4000))


for _f in (separate_ica, low_pass, high_pass, resample):
    QUERIES[_f.__name__] = _f
