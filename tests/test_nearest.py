import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexquarry.functions import scoring
from lexquarry.operators import vectors as V


def made(rng, n, dims):
    """Vectors with exact copies, near copies, multiples, zeros, and some that have no place among them."""
    rows = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(n // 2)]
    rows += [[x * rng.choice([1.0, 2.0, 1.0 + 1e-7]) for x in rng.choice(rows[:5])] for _ in range(n - len(rows))]
    rows += [[0.0] * dims, [0.0] * dims, None, [], [1.0] * (dims - 1) + [None], [1.0] * (dims - 1) + [float("nan")], [1.0] * (dims + 1)]
    rng.shuffle(rows)
    return rows


def brute(queries, vectors, k, metric, part):
    unit = scoring.normalized if metric == "ip" else lambda v: v.cast("array<double>")
    ok = "size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x))"
    a = queries.where(ok).select("query_id", unit(F.col("embedding")).alias("q"))
    b = vectors.where(ok).select("ord", *part, unit(F.col("embedding")).alias("v"))
    raw = scoring.inner(F.col("q"), F.col("v")) if metric == "ip" else scoring.squared_distance(F.col("q"), F.col("v"))
    every = a.crossJoin(b).where("size(q) = size(v)").withColumn("raw", raw)
    order = F.desc("raw") if metric == "ip" else F.asc("raw")
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", *part).orderBy(order, "ord"))).where(F.col("rank") <= k)


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("small", ["blocks", "kept", "broadcast"])
def test_against_all_pairs(spark, monkeypatch, metric, small):
    rng, dims = random.Random(5), 24
    if small != "broadcast":
        monkeypatch.setattr(V, "BLOCK_BYTES", 40 * 8 * dims)
        monkeypatch.setattr(V, "EXACT_BYTES", 3000)
    if small == "kept":
        monkeypatch.setattr(V, "KEPT_BYTES", 10_000)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        held = [(i, rng.choice(["A", "B", None]), v) for i, v in enumerate(made(rng, 500, dims))]
        vectors = spark.createDataFrame(held, "ord long, tier string, embedding array<float>").repartition(3)
        queries = spark.createDataFrame([(f"q{i}", v) for i, _, v in held[:120]], "query_id string, embedding array<float>")
        for part in (None, "tier"):
            own = [part] if part else []
            got = V.nearest(queries, vectors, 7, metric, part)
            columns = ["query_id", *own, "ord", "raw", "rank"]
            assert got.columns == ["query_id", *own, "ord", "raw", "rank"]
            want = brute(queries, vectors, 7, metric, own)
            assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty(spark):
    none = spark.createDataFrame([], "ord long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    assert V.nearest(one, none, 3).count() == 0
    assert V.nearest(one.where("false"), one.withColumnRenamed("query_id", "ord"), 3).count() == 0


def test_only_the_best_of_a_block_go_on():
    rng = np.random.default_rng(2)
    held, asked = rng.normal(size=(5000, 16)), rng.normal(size=(30, 16))
    query, place, row, value = V.block_best(held, asked, np.arange(5000), np.full(30, -np.inf), 20, "ip")
    assert len(query) == 600 and place.max() == 19
    best, bar = V.Best(20), None
    best.add(0, 30, query, place, value)
    bar = best.bar(0, 30)
    assert np.allclose(bar, np.sort(held @ asked.T, axis=0)[-20])
    again = V.block_best(rng.normal(size=(5000, 16)), asked, np.arange(5000), bar, 20, "ip")
    assert len(again[0]) < 600  # what can't reach the values so far is not sent on
