"""Parts of the near-duplicate operators that keep them in proportion to the corpus."""

import random

import numpy as np
from pyspark.sql import functions as F

from wavelattice.llm import simhash
from wavelattice.llm._util import Scratch, components, connected_components, prepare

R = random.Random(11)


def words(n):
    return " ".join(f"w{R.randrange(10**6)}" for _ in range(n))


def test_components_both_ways(spark):
    edges = [(k, k + 1) for k in R.sample(range(300), 200)] + [(1000, k) for k in range(400, 500)] + [(7, 7), (5, 4), (4, 5)]
    table = spark.createDataFrame(edges, "u long, v long")
    few, many = ({tuple(r) for r in connected_components(table, gathered=n).collect()} for n in (10_000, 0))
    assert few == many and len(few) > 200
    assert connected_components(table.limit(0)).count() == 0
    nodes, labels = components(np.arange(1, 2000), np.arange(1999))
    assert len(nodes) == 2000 and not labels.any()


def test_few_edges_take_few_jobs(spark):
    """Each round of jobs adds to the driver's memory."""
    path = np.random.default_rng(3).permutation(3000).tolist()
    edges = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "u long, v long")
    spark.sparkContext.setJobGroup("components", "")
    try:
        found = connected_components(edges)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.where("label = 0").count() == 3000 and jobs <= 12


def texts(spark):
    """A passage that all of 60 different texts hold, and one near copy."""
    common = words(12)
    rows = [(k, f"{words(30)} {common} {words(30)}") for k in range(60)]
    rows.append((60, rows[0][1].replace(" ", " x ", 1)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_common_shingles_make_no_pairs(spark):
    keyed = simhash._keyed(texts(spark))
    sets = simhash.shingle_prefixes(keyed, 5, simhash.frequent_shingles(keyed, 5, Scratch(spark)))
    keys = sets.select("_id", F.explode("prefix").alias("key")).groupBy("key").agg(F.collect_set("_id").alias("ids")).where("size(ids) > 1")
    assert {tuple(sorted(r.ids)) for r in keys.collect()} == {(0, 60)}


def test_near_copies_are_looked_for_by_fingerprints(spark, monkeypatch):
    asked = []
    plain = simhash.links

    def links(distinct, max_bits=2):
        asked.append(distinct.count())
        return plain(distinct, max_bits)

    monkeypatch.setattr(simhash, "links", links)
    docs = texts(spark)
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == list(range(60))
    assert asked == [61]
    long = words(3000)
    docs = spark.createDataFrame([(1, long), (2, f"{long} end"), (3, words(3000))], "doc_id long, text string")
    first = simhash.shingle_prefixes(simhash._keyed(docs), 5)
    found = simhash.print_pairs(first).collect()
    near = {r._id: r.node for r in first.collect()}
    assert [set(r) for r in found] == [{near[1], near[2]}]
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [1, 3]


def test_exploded_tables_are_not_broadcast(spark):
    """Spark sizes a table as if explode added no rows, so a small one became a large broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    prepare(spark)
    prints = spark.range(3000).select(F.xxhash64("id").alias("fp")).distinct()
    found = simhash.links(prints)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
