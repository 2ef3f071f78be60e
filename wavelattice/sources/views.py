"""Signals derived from the relational tables.

Long layout: item string, ch int, n bigint, x double; sources add label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task gets, about: some 1,800 bytes each once they are cells of spectra, of which there are several a sample and source.
SHARE = 50_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key to as many tasks as there are SHARE rows, after a count; few rows stay as they are.

    Adaptive execution sizes tasks before samples become cells, and the session's
    number of partitions does not follow the input; windows and groupings of an
    item keep these tasks.
    """
    tasks = -(-rows.count() // SHARE)
    return rows.repartition(tasks, key) if tasks > 4 else rows


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mono signal per user: the values of their events in time order; keeps the event's type as label."""
    w = Window.partitionBy("item").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("item"), "ts", "event_id", "value", "event_type")
    return spread(rows, "item").select(
        "item", F.lit(0).alias("ch"), (F.row_number().over(w) - 1).cast("bigint").alias("n"), F.col("value").cast("double").alias("x"), F.col("event_type").alias("label")
    )


def event_sources(signals: DataFrame, labels: list[str]) -> DataFrame:
    """One source per label: the signal where the sample has that label, else 0; sources sum to the signal."""
    return signals.select("item", "ch", "n", F.explode(F.array(*(F.struct(F.lit(v).alias("label"), F.when(F.col("label") == v, F.col("x")).otherwise(0.0).alias("x")) for v in labels))).alias("s")).select("item", "s.label", "ch", "n", "s.x")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("item").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("item"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return spread(rows, "item").select("item", (F.row_number().over(w) - 1).cast("bigint").alias("n"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def line_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dense sources per supplier."""
    made = [("a", F.col("l_quantity").cast("double")), ("b", F.col("l_discount").cast("double") * 1000), ("c", F.col("l_tax").cast("double") * 1000)]
    return _line_rows(spark, sf_dir).select("item", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("label"), v.alias("x")) for k, v in made))).alias("s")).select("item", "s.label", F.lit(0).alias("ch"), "n", "s.x")


def line_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels per supplier."""
    made = [(0, F.col("l_quantity").cast("double")), (1, F.col("l_extendedprice").cast("double") / 1000)]
    return _line_rows(spark, sf_dir).select("item", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("ch"), v.alias("x")) for k, v in made))).alias("s")).select("item", "s.ch", "n", "s.x")


#: The same views in DuckDB SQL, as common table expressions.
SQL = {
    "sig": "sig AS (SELECT CAST(user_id AS VARCHAR) item, 0 ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 n, CAST(value AS DOUBLE) x, event_type label FROM events)",
    "src": "src AS (SELECT item, l.label, ch, n, CASE WHEN sig.label = l.label THEN x ELSE 0.0 END x FROM sig, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) label) l)",
    "line": "line AS (SELECT CAST(l_suppkey AS VARCHAR) item, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 n, CAST(l_quantity AS DOUBLE) q, CAST(l_extendedprice AS DOUBLE) / 1000 p, CAST(l_discount AS DOUBLE) * 1000 d, CAST(l_tax AS DOUBLE) * 1000 t FROM lineitem)",
    "lsrc": "lsrc AS (SELECT item, 'a' label, 0 ch, n, q x FROM line UNION ALL SELECT item, 'b', 0, n, d FROM line UNION ALL SELECT item, 'c', 0, n, t FROM line)",
    "st": "st AS (SELECT item, 0 ch, n, q x FROM line UNION ALL SELECT item, 1, n, p FROM line)",
}
