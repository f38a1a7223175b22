"""Volume queries over orders whose keys, and so volumes, are those of large tables."""

import duckdb
import pytest

from pergamo import volumes as V
from pergamo.volumes import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """A folder with orders of volumes 100, 999, 10,000 and 67,475."""
    d = tmp_path_factory.mktemp("far")
    rows = f"SELECT o_orderkey + k AS o_orderkey, * EXCLUDE (o_orderkey, k) FROM '{SMALL}/orders.parquet', (VALUES (0), (719200), (7920000), (53900000)) s(k) WHERE o_orderkey < 30"
    duckdb.sql(f"COPY ({rows}) TO '{d}/orders.parquet' (FORMAT parquet)")
    return str(d)


def differing(spark, d, name):
    """Rows of a query and of its SQL that the other lacks."""
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{d}/orders.parquet'")
    df = QUERIES[name](spark, d)
    names = sorted(df.columns)
    want = c.sql(ORACLE[name])
    assert sorted(want.columns) == names
    at = [list(want.columns).index(n) for n in names]
    got, rows = {tuple(r) for r in df.select(*names).collect()}, {tuple(r[i] for i in at) for r in want.fetchall()}
    assert rows
    return got ^ rows


@pytest.mark.parametrize("name", ["volume_pages", "volume_texts", "volume_sections", "volume_chunks", "volume_metadata", "volume_citations", "volume_incoming"])
def test_volumes_of_long_numbers(spark, far, name):
    assert not differing(spark, far, name)


def test_work_is_dealt_to_all_cores(spark, far):
    """One file of orders is read by one task; what is made of it is not."""
    for step in (V.pages, V.texts, V.metadata, V.cited):
        assert len(step(spark, far).inputFiles()) >= spark.sparkContext.defaultParallelism, step.__name__


def test_sections_are_cut_within_rows(spark, far):
    """No shuffle and no window over single lines."""
    from pergamo.operators.sections import cut_texts

    plan = cut_texts(V.texts(spark, far))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_captions_are_read_once(spark, far):
    """No filter repeats what finds a caption."""
    from pergamo.operators.rulings import segment

    plan = segment(V.entries(spark, far), V.pages(spark, far))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line.split("(")[0] and "lambdafunction" in line]


def test_incoming_is_counted_without_pairs(spark):
    """The counts of `incoming`, from citations counted a page: itself, nulls, repeats, ranges over blocks and past their end."""
    from pergamo.operators import citations as Q

    cites = [(c, t, p, "") for c in ("a", "b", "c", None) for t in (1, 2, None) for p in (1, 15, 16, 17, 40, None) for _ in range(3)]
    rulings = [("a", 1, 1, 16), ("a", 2, 10, 40), ("b", 1, 17, None), ("c", 2, 5, 2), (None, 1, 1, 40), ("d", 1, 14, 100), ("d", 1, 14, 100), ("e", 3, 1, 2), ("f", 1, None, 2)]
    c = spark.createDataFrame(cites, "cita string, tomo_citado int, pagina_citada int, contexto string")
    r = spark.createDataFrame(rulings, "cita string, tomo int, pagina_inicio int, pagina_fin int")
    want = {x.citado: x["count"] for x in Q.incoming(c, r).groupBy("citado").count().collect()}
    assert want and {x.citado: x.n for x in Q.incoming_counts(c, r).collect()} == want


def test_pages_are_split_once_and_filtered(spark):
    """No word of a page splits it anew, and only words that a chunk begins with shuffle."""
    from pergamo.operators import chunks as C

    pages = spark.createDataFrame([("x", 1, "uno dos tres cuatro cinco seis siete")], "cita string, pagina_oficial int, texto string")
    chunks = spark.createDataFrame([("x", 0, "dos tres cuatro cinco seis"), ("x", 1, "seis siete")], "cita string, orden int, texto string")
    found = C.locate_chunks(chunks, pages, ["cita", "orden"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(split(texto" not in plan and "getbit" in plan
    assert sorted(tuple(r) for r in found.collect()) == [("x", 0, 1), ("x", 1, 1)]
