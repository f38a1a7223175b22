"""Bucketed tables: which buckets a getter reads, and joins without an exchange."""

import pytest
from pyspark.sql import functions as F

from pergamo.sources import keyed
from tests.test_lexical_store import rows_read


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_getters_prune_and_joins_do_not_shuffle(spark, tmp_path):
    rows = spark.range(0, 2000).select((F.col("id") % 500).alias("cita"), F.col("id").cast("int").alias("orden"), F.concat(F.lit("t"), "id").alias("texto"))
    a = keyed.write_keyed(rows, str(tmp_path / "a"), ("cita",), 8, ("orden",))
    b = keyed.write_keyed(rows.where("orden % 3 = 0").select("cita", F.col("orden").alias("otro")), str(tmp_path / "b"), ("cita",), 8)
    assert [r.orden for r in a.get(7).collect()] == [7, 507, 1007, 1507] and a.get(None).collect() == a.get(-1).collect() == []
    assert 4 <= rows_read(a.get(7)) < 2000 / 4 and rows_read(a.data) == 2000 and "PushedFilters: [IsNotNull(cita), EqualTo(cita,7)]" in plan(a.get(7))
    assert "Exchange" not in plan(a.get(7))
    joined = a.join(b)
    assert joined.count() == rows.join(rows.where("orden % 3 = 0").select("cita"), "cita").count()
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert "Exchange" not in plan(a.data.groupBy("cita").count())
    again = keyed.open_keyed(spark, str(tmp_path / "a"))
    assert [r.orden for r in again.scan().limit(5).collect()] == [0, 500, 1000, 1500, 1]
    many = again.get_many(spark.createDataFrame([(1,), (1,), (None,), (900,)], "cita long"))
    assert sorted(r.orden for r in many.collect()) == [1, 501, 1001, 1501]
    new = keyed.write_keyed(rows.limit(0), str(tmp_path / "a"), ("cita",), 8, ("orden",))
    assert new.scan().count() == 0 and again.scan().count() == 2000
    with pytest.raises(ValueError):
        a.get(1, 2)
    with pytest.raises(ValueError):
        a.join(keyed.write_keyed(rows, str(tmp_path / "c"), ("cita",), 4))


def test_two_columns_and_nulls(spark, tmp_path):
    rows = spark.createDataFrame([("1:1", 0, "a"), ("1:1", 1, "b"), (None, 0, "c"), ("2:1", None, "d")], "cita string, orden int, texto string")
    t = keyed.write_keyed(rows, str(tmp_path / "t"), ("cita", "orden"), 3)
    assert [r.texto for r in t.get("1:1", 1).collect()] == ["b"] and t.scan().count() == 4
