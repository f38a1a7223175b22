"""Hard negatives against brute force over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pergamo.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def slow(rows, k=5, m=5, percent=80, scale=256):
    """rows: (id, vector, label); anchors: id divisible by 100."""
    ok = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, v, y in ok:
        if i is None or i % 100:
            continue
        scored = [(dot(v, w), j, z) for j, w, z in ok]
        for p, j, _ in sorted((r for r in scored if r[2] == y and r[1] != i), key=order)[:k]:
            fits = sorted((r for r in scored if r[2] != y and percent * p <= 100 * r[0] <= 100 * p), key=order)[:m]
            out += [(i, j, n + 1, r[1], p, r[0]) for n, r in enumerate(fits)]
    return sorted(out, key=str)


def run(spark, rows, monkeypatch=None, **more):
    df = spark.createDataFrame([(i, v, y, 0.5, 1) for i, v, y in rows], SCHEMA)
    got = H.hard_negatives(df.repartition(3), F.col("vec_id") % 100 == 0, **more)
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()), key=str)


def clustered(n, dim, labels, seed, spread=0.05, step=10):
    """Vectors around a few directions; ids are multiples of step, so every (100 / step)th is an anchor."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels * 2, dim)) / math.sqrt(dim)
    return [(step * i, np.float32(centres[c := int(rng.integers(len(centres)))] + rng.normal(size=dim) * spread / math.sqrt(dim)).tolist(), c % labels) for i in range(n)]


@pytest.mark.parametrize("tree, tile, limit", [(512, 8192, 8_000_000), (3, 40, 200)])
def test_against_brute_force(spark, monkeypatch, tree, tile, limit):
    """With trees, tiles and rounds of any size."""
    for name, value in (("TREE", tree), ("TILE", tile), ("ROUND", limit)):
        monkeypatch.setattr(H, name, value)
    rows = clustered(300, 16, 4, 1)
    want = slow(rows)
    assert want and run(spark, rows) == want


def test_edges(spark):
    """Nulls anywhere, non-finite, zero and empty vectors, ties, repeated rows and anchors, negative ids, one label, no rows."""
    rng = random.Random(2)
    v = lambda: [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)]
    rows = [(i, v(), rng.randrange(3)) for i in range(-200, 400, 5)]
    rows += [(100, v(), 1), (100, None, 1), (105, v(), None), (None, [0.5] * 4, 0), (None, [0.5] * 4, 1), (106, [0.5, None, 0.5, 0.5], 1), (107, [0.5, float("nan"), 0.5, 0.5], 1), (108, [0.5, float("inf"), 0.5, 0.5], 1), (500, [0.0] * 4, 0), (600, [], 2), (601, [1.0], 2), (602, [0.5, 0.5], 1)]
    rows += [rows[3], rows[3], (0, rows[40][1], rows[40][2])]
    assert run(spark, rows) == slow(rows)
    assert run(spark, [(100 * i, v(), 7) for i in range(5)]) == []
    assert run(spark, [(1, v(), 7)]) == [] == run(spark, [])


def test_scores_beyond_doubles(spark):
    rows = [(10 * i, [3e5 + i / 3, 1e4 * i, -2e5 + i / 7], i % 3) for i in range(40)]
    rows = [(i, np.float32(v).tolist(), y) for i, v, y in rows]
    assert max(r[4] for r in slow(rows)) > 2**53 / 1000 and run(spark, rows, scale=256) == slow(rows)
    assert run(spark, rows, scale=1 << 12) == slow(rows, scale=1 << 12) and max(r[4] for r in slow(rows, scale=1 << 12)) > 2**53


def test_bounds_spare_most_products():
    """Anchors that are alike: most rows of other directions are never scored again; all that are needed are met."""
    rows = clustered(3000, 32, 3, 4, spread=0.02)
    v = np.floor(H.matrix([r[1] for r in rows]) * 256)
    labels = np.array([r[2] for r in rows])
    chosen = [i for i in np.flatnonzero(labels == 0)[:200].tolist()]
    order, parent, edge = H.spanning_tree(v[chosen])
    assert sorted(order.tolist()) == list(range(len(chosen))) and (parent[1:] < np.arange(1, len(chosen))).all()
    assert edge[1:] == pytest.approx([np.linalg.norm(v[chosen][o] - v[chosen][order[p]]) for o, p in zip(order[1:], parent[1:])])
    a = v[chosen][order]
    tree = {"label": 0, "id": [rows[chosen[o]][0] for o in order], "parent": parent, "edge": edge, "v": a, "norm": np.linalg.norm(a, axis=1) * (1 + 1e-9)}
    tile = H.Tile([r[0] for r in rows], labels, list(v), 32)
    held = [[] for _ in chosen]
    made = H.nearest_alike(tile, tree, held, 5)
    assert made < 0.9 * len(chosen) * (labels == 0).sum()
    exact = v @ a.T
    for i, h in enumerate(held):
        want = sorted(((int(exact[j, i]), rows[j][0]) for j in np.flatnonzero(labels == 0) if rows[j][0] != tree["id"][i]), key=lambda r: (-r[0], r[1]))[:5]
        assert h == want
    negatives: dict = {}
    made = H.windows_met(tile, tree, [[r[0] for r in h] for h in held], negatives, 5, 80)
    assert made < 0.5 * len(chosen) * (labels != 0).sum()


def test_a_third_of_all_rows_have_one_label_and_vector(spark):
    rows = [(i, [0.5, 0.25], 0) for i in range(200)] + clustered(60, 2, 3, 5, step=50) + [(10_000 + i, [0.5, 0.25], 1) for i in range(100)]
    assert run(spark, rows) == slow(rows)


def test_query_equals_its_sql(spark):
    """The registered query and its SQL over the whole smallest table."""
    import duckdb

    from pergamo.llm.queries import ORACLE, QUERIES

    path = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = QUERIES["op13_hard_negatives"](spark, path)
    assert sorted(got.columns) == sorted(names)
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({ORACLE['op13_hard_negatives']})").fetchall()
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want) != []
