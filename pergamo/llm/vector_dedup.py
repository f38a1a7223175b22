"""Embedding near-duplicates by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamo.llm.common import apply, mix64, table
from pergamo.plans.components import components
from pergamo.plans.skew import attach_groups
from pergamo.session import settle

COSINE = 0.95
#: Trees, vectors a leaf should hold, levels at most, rows of the sample that places the splits.
TREES, LEAF, MOST_LEVELS, SAMPLE = 6, 512, 20, 10_000
#: Spill to either side of a split, in standard deviations that a linked pair differs by along a random direction, in
#: a tree of one level. It narrows with the root of the levels, so that a vector goes to about as many leaves in a
#: table of any size: 16 of 50,000 vectors, 23 of 5 million. A tree parts a pair right at the threshold with a chance
#: of 0.1 and 0.3 there; all TREES do with 1e-6 and 1e-3.
SPILL = 1.6
#: Vectors of a leaf above which it is split into cells, one for each pair of blocks.
CELL = 4096
ROOM = 1 << 22
#: Vectors of a block: so many by so many are compared at once.
STEP = 1024


class Forest:
    """Random directions per level and thresholds per node of each tree, for vectors of any length.

    Splits sit at the median of the sample rows that reach a node, or at zero where fewer than 16 do and for
    vectors of another length than the sample's. A vector within the spill of a threshold goes to both sides.
    The size is fixed by TREES, MOST_LEVELS and the longest vector.
    """

    def __init__(self, sample: np.ndarray, n: int, longest: int, cosine: float, seed: int = 5) -> None:
        self.dim = sample.shape[1]
        self.levels = int(np.clip(np.ceil(np.log2(max(1, n) / LEAF)), 0, MOST_LEVELS))
        self.spill = SPILL / np.sqrt(max(1, self.levels)) * np.sqrt(max(0.0, 2 - 2 * cosine))
        self.directions = np.random.default_rng(seed).standard_normal((TREES, self.levels, longest))
        self.thresholds = [[np.zeros(1 << k) for k in range(self.levels)] for _ in range(TREES)]
        for t in range(TREES):
            node = np.zeros(len(sample), np.int64)
            for k in range(self.levels):
                at = self._along(sample, t, k)
                order = np.lexsort((at, node))
                ids, first, count = np.unique(node[order], return_index=True, return_counts=True)
                some = count >= 16
                self.thresholds[t][k][ids[some]] = at[order][first[some] + count[some] // 2]
                node = node * 2 + (at > self.thresholds[t][k][node])
        self.parts: dict[int, int] = {}
        if len(sample):
            _, leaf = self.leaves(sample)
            ids, count = np.unique(leaf, return_counts=True)
            self.parts = {int(i): int(-(-c // CELL)) for i, c in zip(ids, count * (n / len(sample))) if c > CELL}

    def _along(self, x: np.ndarray, t: int, k: int) -> np.ndarray:
        """Along a direction; differences of unit vectors at a distance of d have the standard deviation d / sqrt(dim)."""
        way = self.directions[t, k, : x.shape[1]]
        return x @ (way / np.linalg.norm(way)) if len(x) else np.zeros(0)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves of all trees that unit vectors of one length reach, by row and leaf."""
        rows, out, spill = [], [], self.spill / np.sqrt(max(1, x.shape[1]))
        own = x.shape[1] == self.dim
        for t in range(TREES):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k in range(self.levels):
                off = self._along(x, t, k)[row] - (self.thresholds[t][k][node] if own else 0.0)
                left, right = off <= spill, off >= -spill
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
            rows.append(row)
            out.append(node + t * ROOM + (x.shape[1] << 26))
        row, leaf = np.concatenate(rows), np.concatenate(out)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def is_usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True, initial=0.0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, block: np.ndarray, cell: tuple[int, int], earlier: list[np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links counted here, root) of each vector of a leaf or of one cell of it.

    A pair counts in the first leaf that both reach only, and in one cell of it, so counts add up without
    listing pairs; roots join what links here at all. Blocks that hold links are compared again until no root
    changes, so no more than STEP x STEP pairs are held at once.
    """
    n = len(ids)
    all_ = np.concatenate(earlier) if n else np.zeros(0, np.int64)
    names = np.unique(all_)
    reach = np.zeros((n, len(names)), np.float32)
    reach[np.repeat(np.arange(n), [len(e) for e in earlier]), np.searchsorted(names, all_)] = 1
    links, root = np.zeros(n, np.int64), np.arange(n)

    def near_in(a: int, b: int) -> np.ndarray:
        near = x[a : a + STEP] @ x[b : b + STEP].T >= cosine
        if a == b:
            np.fill_diagonal(near, False)
        return near

    def join(a: int, b: int, near: np.ndarray) -> None:
        for p, q, m in ((a, b, near), (b, a, near.T)):
            low = np.where(m, root[q : q + STEP], n).min(1, initial=n)
            root[p : p + STEP] = np.minimum(root[p : p + STEP], low)

    linked: list[tuple[int, int]] = []
    for a in range(0, n, STEP):
        for b in range(a, n, STEP):
            near = near_in(a, b)
            if not near.any():
                continue
            linked.append((a, b))
            join(a, b, near)
            here, there = block[a : a + STEP, None], block[None, b : b + STEP]
            mine = near & (((here == cell[0]) & (there == cell[1])) | ((here == cell[1]) & (there == cell[0])))
            if reach.shape[1]:
                mine &= ~((reach[a : a + STEP] @ reach[b : b + STEP].T) > 0)
            links[a : a + STEP] += mine @ weight[b : b + STEP]
            if a != b:
                links[b : b + STEP] += mine.T @ weight[a : a + STEP]
    while linked:
        before = root.copy()
        root = root[root]
        for a, b in linked:
            join(a, b, near_in(a, b))
        root = root[root]
        if (root == before).all():
            break
    return links, root


def vector_dedup(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Equal vectors become one class first, so copies of one vector cost one comparison; a class counts for its
    links as many times as it has rows. Classes go to every leaf that the forest's splits and spills lead to
    and are compared within leaves in double precision; found pairs are verified against the threshold and
    joined by distributed union-find. The forest is fitted on SAMPLE rows in expectation and indexes all rows.
    Leaves that the sample tells to be large are split into cells, one for each pair of blocks.

    Vectors of each length are compared among themselves. Null vectors and those that are empty, zero or hold
    null or non-finite components link with nothing. Null ids are ignored as representatives. Repeated rows
    count as copies. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    double = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(is_usable(double), double))
    rows = settle(rows.withColumn("key", F.when(F.col("v").isNotNull(), F.concat_ws(":", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v"))))))
    sizes = rows.where("v is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 0
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    usable = rows.where("key is not null")
    classes = settle(usable.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).withColumn("cid", F.xxhash64("key")))
    total, many = rows.count(), classes.count()
    share = min(1.0, SAMPLE / max(1, many))
    picked = classes.where(F.pmod(F.xxhash64(F.lit(3), "cid"), F.lit(1 << 30)) < int(share * (1 << 30))).where(F.size("v") == dim).select("v")
    sample = np.array([r["v"] for r in picked.collect()], float).reshape(-1, max(1, dim))
    shared = spark.sparkContext.broadcast(Forest(_unit(sample), many, max(1, longest), cosine))
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    width = np.float32 if kind == "float" else np.float64  # what holds the components as they came

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                if not b.num_rows:
                    continue
                size = np.diff(b.column(2).offsets.to_numpy())
                if (size != size[0]).any():
                    for d in np.unique(size):  # one length at a time
                        yield from place(iter([pa.RecordBatch.from_arrays([c.take(pa.array(np.flatnonzero(size == d))) for c in b.columns], names=b.schema.names)]))
                    continue
                raw = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                x = _unit(raw)
                row, leaf = forest.leaves(x)
                first = np.searchsorted(row, np.arange(len(x)))
                own = mix64(b.column(0).to_numpy().view(np.uint64))
                at, cell, block = [], [], []
                for i, (r, f) in enumerate(zip(row.tolist(), leaf.tolist())):
                    s = forest.parts.get(f, 1)
                    mine = int(own[r] % np.uint64(s))
                    for c in range(s):
                        at.append(i)
                        cell.append(min(mine, c) * s + max(mine, c))
                        block.append(mine)
                at = np.array(at, np.int64)
                before = pa.array([leaf[first[row[i]] : i].tobytes() for i in at.tolist()], pa.binary())
                unit = pa.array([v.tobytes() for v in raw.astype(width)], pa.binary()).take(pa.array(row[at]))
                parts = pa.array(np.array([forest.parts.get(f, 1) for f in leaf[at].tolist()], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[at]), pa.array(np.array(cell, np.int64)), pa.array(np.array(block, np.int64)), parts, b.column(0).take(pa.array(row[at])), b.column(1).take(pa.array(row[at])), unit, before],
                    names=["leaf", "cell", "block", "parts", "cid", "n", "v", "before"],
                )

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([t["leaf"].to_numpy(), t["cell"].to_numpy()])
            edge = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, t.num_rows]
            for a, b in zip(edge, edge[1:]):
                if b - a < 2:
                    continue
                g = t.slice(a, b - a)
                ids, s, c = g["cid"].to_numpy(), int(g["parts"][0].as_py()), int(g["cell"][0].as_py())
                x = _unit(np.frombuffer(b"".join(g["v"].to_pylist()), width).astype(float).reshape(b - a, -1))
                links, root = compare(ids, g["n"].to_numpy(), x, g["block"].to_numpy(), (c // s, c % s), [np.frombuffer(e, np.int64) for e in g["before"].to_pylist()], cosine)
                some = np.flatnonzero((links > 0) | (root != np.arange(b - a)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some])], names=["a", "b", "links"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            leaf, cell = t["leaf"].to_numpy(), t["cell"].to_numpy()
            other = np.flatnonzero((leaf != leaf[-1]) | (cell != cell[-1]))
            if len(other):
                yield from solve(t.slice(0, other[-1] + 1))
                held = t.slice(other[-1] + 1).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    if many:
        placed = apply(classes.select("cid", "n", "v"), place, "leaf long, cell long, block long, parts long, cid long, n long, v binary, before binary")
        found = settle(apply(placed.repartition("leaf", "cell").sortWithinPartitions("leaf", "cell"), within, "a long, b long, links long"))
        links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
        parts = components(found.where("a <> b"))
        member = classes.select("key", "cid", "low", "n").join(parts, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cid")).drop("node", "component")
        member = settle(member.join(links, "cid", "left"))
        lows = settle(member.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("size")))
        member = settle(attach_groups(member, lows, "root", "size", total).select("key", "n", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
        out = attach_groups(rows.select("id", "key").where("key is not null"), member, "key", "n", total).unionByName(rows.where("key is null").select("id", "key", F.lit(1).cast("long").alias("n"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
    else:
        out = rows.select("id", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_vector_dedup": op5_vector_dedup}
