"""Hot keys, bitmaps and components."""

import random

from pyspark.sql import functions as F

from pergamo.plans import bitmap, skew
from pergamo.plans.components import components


def tasks(df):
    return [n for (n,) in df.groupBy(F.spark_partition_id()).count().select("count").collect()]


def test_a_hot_key_is_spread(spark):
    """A key with 40 % of the rows, broadcasts of small tables off: no task gets more than a few times the mean."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = 50_000
        rows = spark.range(0, n, 1, 16).select("id", F.when(F.col("id") % 5 < 2, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 2000 + 100).alias("k"))
        groups = rows.where("k is not null and k <> 150").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
        out = skew.attach_groups(rows, groups, "k", "n", n)
        sizes = tasks(out)
        assert sum(sizes) == n and max(sizes) < 3 * n / 40
        want = {(r.k): (r.n, r.low) for r in groups.collect()}
        got = out.collect()
        assert all((r.n, r.low) == want.get(r.k, (None, None)) for r in got) and len({r.id for r in got}) == n
        assert "hashpartitioning(k" in out._jdf.queryExecution().toString() and "BroadcastHashJoin" in out._jdf.queryExecution().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_rows_are_what_a_task_holds():
    assert skew.hot_rows(10) == 1000 and skew.hot_rows(10**8) == 100_000 and skew.hot_rows(10**12) == skew.TASK_ROWS


def test_bitmap(spark):
    keys = spark.range(0, 3000).select((F.col("id") * 7919).alias("k"))
    bits = bitmap.filter_bits(3000)
    f = bitmap.build(keys, "k", bits)
    rows = spark.range(0, 60_000).select(F.col("id").alias("k"))
    got = bitmap.probe(rows, "k", f, bits, "maybe").where("maybe").select("k").collect()
    want = {7919 * i for i in range(3000) if 7919 * i < 60_000}
    assert want <= {r.k for r in got} and len(got) < len(want) + 60
    twice = bitmap.build(keys.union(keys.where("k < 79190")), "k", bits, least=2)
    assert {r.k for r in bitmap.probe(rows, "k", twice, bits, "maybe").where("maybe").collect()} >= {7919 * i for i in range(8)}
    assert bitmap.probe(rows, "k", twice, bits, "maybe").where("maybe").count() < 600
    none = bitmap.build(keys.limit(0), "k", bits)
    assert bitmap.probe(rows, "k", none, bits, "maybe").where("maybe").isEmpty()


def test_components_with_a_hub_and_a_chain(spark):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(60)] + [(9000, 9000), (None, 1), (9001, None)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(3000)} | {5000 + i: 5000 for i in range(61)}
