"""Hard negatives: scores along spanning trees of anchors, bounded by the length of an edge, rescored where a window needs it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pergamo.llm.common import apply, table
from pergamo.session import settle, ship_code

#: Positives of an anchor, negatives of each positive; a negative has NEAR_PERCENT to 100 % of the positive's score; components are times SCALE.
POSITIVES, NEGATIVES, NEAR_PERCENT, SCALE = 5, 5, 80, 256
#: Anchors of a tree; components of the anchors that are broadcast at once (64 MB); rows that a task scores at once, and rows of a task.
TREE, ROUND, TILE, TASK = 512, 8_000_000, 8192, 65_536
#: Below it sums of products of doubles are exact.
EXACT = float(1 << 53)


def whole_vectors(rows: DataFrame, id_col: str, label_col: str, vector_col: str, is_anchor: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, anchor, v): floor(scale * x) of each component, as doubles that are integers.

    Rows with a null label, a null vector or a null or non-finite component are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [None if v is None or None in v else np.floor(np.array(v, np.float64) * scale) for v in b.column(3).to_pylist()]
            ok = np.array([v is not None and bool(np.isfinite(v).all()) for v in vectors], bool)
            keep = pa.array(ok)
            found = pa.array([v for v, k in zip(vectors, ok) if k], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in range(3)] + [found], names=["id", "label", "anchor", "v"])

    x = rows.select(F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.coalesce(is_anchor, F.lit(False)), F.col(vector_col).cast("array<double>"))
    return apply(x.toDF("id", "label", "anchor", "v").where("label is not null and v is not null"), run, "id long, label long, anchor boolean, v array<double>")


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree (Prim's) of the rows of v: order has parents before their
    children, parent counts in that order (-1: the root, the row nearest to the mean), edge is the distance to the parent."""
    n = len(v)
    root = int(((v - v.mean(0)) ** 2).sum(1).argmin())
    order, parent, edge = [root], [-1], [0.0]
    best, via = np.full(n, np.inf), np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    at = root
    for place in range(1, n):
        open_[at] = False
        far = ((v - v[at]) ** 2).sum(1)
        closer = open_ & (far < best)
        best[closer], via[closer] = far[closer], place - 1
        at = int(np.where(open_, best, np.inf).argmin())
        order.append(at)
        parent.append(int(via[at]))
        edge.append(float(np.sqrt(best[at])))
    return np.array(order), np.array(parent), np.array(edge)


def anchor_trees(anchors: DataFrame) -> DataFrame:
    """(tree, place, parent, edge, id, label, v): anchors of one label, TREE at most, as spanning trees.

    Anchors are sorted by label and first component, by range, so a tree's anchors are alike; a label of very many anchors is cut
    into many trees in many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            v = matrix(group["v"])
            order, parent, edge = spanning_tree(v)
            ids = [group["id"][i] for i in order]
            yield pa.RecordBatch.from_arrays(
                [pa.array([group["first"]] * len(order), pa.int64()), pa.array(np.arange(len(order), dtype=np.int32)), pa.array(parent.astype(np.int32)), pa.array(edge), pa.array(ids, pa.int64()), pa.array([group["label"]] * len(order), pa.int64()), pa.array([group["v"][i] for i in order], pa.list_(pa.float64()))],
                names=["tree", "place", "parent", "edge", "id", "label", "v"],
            )

    lead = F.coalesce(F.get("v", F.lit(0)), F.lit(0.0))
    numbered = anchors.repartitionByRange("label", lead, "id").sortWithinPartitions("label", lead, "id").select("id", "label", "v", F.monotonically_increasing_id().alias("row"))
    return settle(apply(numbered, run, "tree long, place int, parent int, edge double, id long, label long, v array<double>"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Runs of rows of one label, TREE at most."""
    group: dict = {"label": None, "id": [], "v": []}
    for b in batches:
        for i, label, v, row in zip(*(b.column(k).to_pylist() for k in range(4))):
            if group["id"] and (label != group["label"] or len(group["id"]) == TREE):
                yield group
                group = {"label": None, "id": [], "v": []}
            if not group["id"]:
                group |= {"label": label, "first": row}
            group["id"].append(i)
            group["v"].append(v)
    if group["id"]:
        yield group


def matrix(vectors: list, width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, which leave every product as it is."""
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(rows: np.ndarray, norms: np.ndarray, anchor: np.ndarray, norm: float) -> np.ndarray:
    """Exact inner products, as doubles where these are exact and as Python integers beyond."""
    if not len(rows) or norms.max() * norm < EXACT:
        return rows @ anchor
    whole = np.array([int(x) for x in anchor.tolist()], object)
    return np.array([sum(int(x) * y for x, y in zip(r, whole)) for r in rows.tolist()], object)


class Tile:
    """Rows that a task scores together: TILE at most, by label."""

    def __init__(self, ids: list, labels: np.ndarray, vectors: list, width: int) -> None:
        self.unknown = np.array([i is None for i in ids], bool)
        self.ids = np.array([i or 0 for i in ids], np.int64)
        self.labels, self.v = labels, matrix(vectors, width)
        self.norms = np.sqrt((self.v**2).sum(1)) * (1 + 1e-9)

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best: higher scores, then smaller ids, null ids last."""
        if len(at) > 64 and scores.dtype != object:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = np.flatnonzero(scores >= cut)
            if len(near) < 1024:
                return near[np.lexsort((self.ids[at[near]], self.unknown[at[near]], -scores[near]))[:k]]
        return np.array(sorted(range(len(at)), key=lambda i: (-scores[i], self.unknown[at[i]], self.ids[at[i]]))[:k], np.int64)


def visit(tile: Tile, at: np.ndarray, tree: dict, needed, meet) -> int:
    """Goes through the tree; at: the rows of the tile that count. Returns how many products were made.

    A row's score at an anchor differs from the one at the anchor's parent by at most the edge's length times the row's norm, so each
    row has an interval of scores, a point after a rescoring. needed(i) gives the window of scores
    that anchor i still needs, from the lower to the upper bounds of all rows; only rows whose interval overlaps it are scored, and
    meet(i, rows, scores) takes them.
    """
    norms, made = tile.norms[at], 0
    low: dict[int, np.ndarray] = {}
    high: dict[int, np.ndarray] = {}
    left = np.bincount(tree["parent"][1:], minlength=len(tree["parent"])) if len(tree["parent"]) > 1 else np.zeros(1, np.int64)
    for i, p in enumerate(tree["parent"].tolist()):
        if p < 0:
            lo, hi = np.full(len(at), -np.inf), np.full(len(at), np.inf)
        else:
            slack = tree["edge"][i] * (1 + 1e-9) * norms + 1
            lo, hi = low[p] - slack, high[p] + slack
            left[p] -= 1
            if not left[p]:
                del low[p], high[p]
        window = needed(i, lo)
        if p < 0:
            some = np.arange(len(at))  # what the bounds of all others start from
        else:
            some = np.flatnonzero((hi >= window[0]) & (lo <= window[1])) if window else np.zeros(0, np.int64)
        if len(some):
            scores = products(tile.v[at[some]], norms[some], tree["v"][i], tree["norm"][i])
            made += len(some)
            lo[some] = hi[some] = scores.astype(np.float64)
            if scores.dtype == object:  # rounded here only
                lo[some] -= np.abs(lo[some]) * 1e-9
                hi[some] += np.abs(hi[some]) * 1e-9
            meet(i, at[some], scores)
        if left[i]:
            low[i], high[i] = lo, hi
    return made


def _put(held: list, tile: Tile, at: np.ndarray, scores: np.ndarray, k: int) -> list:
    """held with the best of these rows: (score, id), the k best in order."""
    if not len(at):
        return held
    new = [(int(scores[i]), None if tile.unknown[at[i]] else int(tile.ids[at[i]])) for i in tile.best(at, scores, k).tolist()]
    return sorted(held + new, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Tile]:
    ids: list = []
    labels: list = []
    vectors: list = []
    for b in batches:
        ids += b.column(0).to_pylist()
        labels += b.column(1).to_pylist()
        values = b.column(2)
        vectors += [v.values.to_numpy() for v in values]
        if len(ids) >= TILE:
            yield Tile(ids, np.array(labels, np.int64), vectors, width)
            ids, labels, vectors = [], [], []
    if ids:
        yield Tile(ids, np.array(labels, np.int64), vectors, width)


def nearest_alike(tile: Tile, tree: dict, held: list[list], k: int) -> int:
    """Adds to held, for each anchor of the tree, the best rows of its label among the tile's."""
    at = np.flatnonzero(tile.labels == tree["label"])
    if not len(at):
        return 0

    def needed(i: int, lo: np.ndarray) -> tuple[float, float]:
        least = held[i][-1][0] if len(held[i]) == k else -np.inf
        if len(lo) > k + 1:  # one of them may be the anchor itself
            least = max(least, float(np.partition(lo, len(lo) - k - 1)[len(lo) - k - 1]))
        return least, np.inf

    def meet(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        other = tile.unknown[rows] | (tile.ids[rows] != tree["id"][i])
        held[i] = _put(held[i], tile, rows[other], scores[other], k)

    return visit(tile, at, tree, needed, meet)


def windows_met(tile: Tile, tree: dict, positives: list[list[int]], held: dict, k: int, percent: int) -> int:
    """Adds to held[anchor, place of the positive] the best rows of other labels in the positive's window of scores."""
    at = np.flatnonzero(tile.labels != tree["label"])
    if not len(at):
        return 0

    def window(i: int, j: int, score: int) -> tuple[int, int]:
        got = held.get((i, j), [])
        least = -((-percent * score) // 100)
        return (max(least, got[-1][0]) if len(got) == k else least), score

    def needed(i: int, lo: np.ndarray) -> tuple[float, float] | None:
        open_ = [window(i, j, s) for j, s in enumerate(positives[i]) if s >= 0]
        return (float(min(w[0] for w in open_)) - 1, float(max(w[1] for w in open_)) + 1) if open_ else None

    def meet(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        for j, s in enumerate(positives[i]):
            a, b = window(i, j, s)
            fits = (scores >= a) & (scores <= b)
            if fits.any():
                held[i, j] = _put(held.get((i, j), []), tile, rows[fits], scores[fits], k)

    return visit(tile, at, tree, needed, meet)


def _rounds(trees: DataFrame) -> Iterator[tuple[list, int]]:
    """Trees in lists of ROUND components at most, so that what is broadcast has a bound; a tree has TREE anchors at most."""
    sizes = [(r.tree, r.n) for r in trees.groupBy("tree").agg(F.sum(F.size("v") + 1).alias("n")).orderBy("tree").toLocalIterator()]
    chosen: list = []
    size = 0
    for tree, n in sizes:
        if chosen and size + n > ROUND:
            yield chosen, size
            chosen, size = [], 0
        chosen.append(tree)
        size += n
    if chosen:
        yield chosen, size


def _fetch(trees: DataFrame, chosen: list) -> list[dict]:
    rows = trees.where(F.col("tree").between(chosen[0], chosen[-1])).orderBy("tree", "place").collect()
    width, out = max(len(r.v) for r in rows), []
    for r in rows:
        if not out or out[-1]["tree"] != r.tree:
            out.append({"tree": r.tree, "label": r.label, "parent": [], "edge": [], "id": [], "v": []})
        for c in ("parent", "edge", "id", "v"):
            out[-1][c].append(r[c])
    for one in out:
        v = matrix(one["v"], width)
        one |= {"v": v, "norm": np.sqrt((v**2).sum(1)) * (1 + 1e-9), "parent": np.array(one["parent"]), "edge": np.array(one["edge"])}
    return out


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = NEAR_PERCENT, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all rows that is_anchor names.

    A score is the inner product of the vectors floor(scale * x), as integers. An anchor's positives are the best `positives` rows of its
    label with another id; for each, the best `negatives` rows of other labels are returned whose score is percent
    to 100 % of the positive's. Best: higher score, then smaller id, null ids last.

    Anchors of a label make minimum spanning trees of TREE anchors at most. Every row is scored at a tree's root;
    from there its score at a child lies within the edge's length times the row's norm of the parent's, and only rows whose interval
    overlaps the window that is still open are scored again. What is open narrows as a task finds rows. Trees are broadcast, 64 MB at
    a time; each task goes over its rows once a round and sends the best few of each anchor, so no pairs leave it, and
    no group meets in one task. Rounds grow with the anchors, as the scores that are asked for do.

    Rows with a null label or vector, or a null or non-finite component, take no part; labels are integers. Repeated rows count each, as
    candidates and as anchors. Vectors of unequal length: missing components count as zero. Scores beyond 2^53 are made of whole
    integers, slowly; beyond 63 bits they raise. An empty table, or one without anchors, gives no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    ship_code(spark)
    vectors = settle(whole_vectors(rows, id_col, label_col, vector_col, is_anchor, scale))
    trees = anchor_trees(vectors.where("anchor").select("id", "label", "v"))
    n = vectors.count()
    tasks = max(spark.sparkContext.defaultParallelism, n // TASK + 1)
    candidates = vectors.select("id", "label", "v").repartition(tasks)
    parts = []
    for chosen, _ in _rounds(trees):
        fetched = _fetch(trees, chosen)
        sent = spark.sparkContext.broadcast(fetched)
        alike = settle(_best(apply(candidates, _alike_run(sent, positives), "tree long, place int, anchor_id long, id long, score long"), ["tree", "place"], positives))
        parts.append(settle(_best(apply(candidates, _window_run(sent, _scores(alike, fetched), negatives, percent), "tree long, place int, nth int, id long, score long"), ["tree", "place", "nth"], negatives).join(
            alike.select("tree", "place", F.col("rank").alias("nth"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["tree", "place", "nth"],
        ).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
        sent.unpersist()
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _best(found: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k best rows of each key, of the k best of each task, with their rank from 1."""
    w = Window.partitionBy(*key).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scores(alike: DataFrame, fetched: list[dict]) -> list[list[list[int]]]:
    """Scores of the positives of each tree's anchors, best first: a few numbers for each anchor of the round."""
    out: list[list[list[int]]] = [[[] for _ in t["id"]] for t in fetched]
    number = {t["tree"]: i for i, t in enumerate(fetched)}
    for r in alike.select("tree", "place", "rank", "score").orderBy("tree", "place", "rank").toLocalIterator():
        out[number[r.tree]][r.place].append(r.score)
    return out


def _alike_run(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        held = [[[] for _ in t["id"]] for t in trees]
        for tile in _tiles(batches, trees[0]["v"].shape[1]):
            for t, h in zip(trees, held):
                nearest_alike(_fit(tile, t), t, h, k)
        for t, h in zip(trees, held):
            got = [(t["tree"], i, t["id"][i], r[1], r[0]) for i, best in enumerate(h) for r in best]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*got), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["tree", "place", "anchor_id", "id", "score"])

    return run


def _window_run(sent, scores: list[list[list[int]]], k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        held: list[dict] = [{} for _ in trees]
        for tile in _tiles(batches, trees[0]["v"].shape[1]):
            for t, s, h in zip(trees, scores, held):
                windows_met(_fit(tile, t), t, s, h, k, percent)
        for t, h in zip(trees, held):
            got = [(t["tree"], i, j + 1, r[1], r[0]) for (i, j), best in h.items() for r in best]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*got), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["tree", "place", "nth", "id", "score"])

    return run


def _fit(tile: Tile, tree: dict) -> Tile:
    """Tile and tree with equally many components."""
    wide, own = tile.v.shape[1], tree["v"].shape[1]
    if own < wide:
        tree["v"] = np.pad(tree["v"], ((0, 0), (0, wide - own)))
    return tile


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are rows whose vec_id is divisible by 100; every seventh row's label moves on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {
    "op13_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS alike,
                   CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(e.v AS DOUBLE[])) AS BIGINT) AS score
            FROM e a, e WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike AND id <> anchor_id
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
        QUALIFY row_number() OVER w <= 5"""
}
