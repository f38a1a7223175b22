"""SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamo.llm.common import apply, hold, map_batches, table
from pergamo.plans.components import components
from pergamo.plans.skew import BROADCAST_ROWS, attach_groups
from pergamo.session import settle

#: Words of a shingle, seed of its hash, differing bits that still link.
SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: The anchors: the direct sum of nine perfect [7, 4] codes, each covering its 7 bits with radius 1; the last bit is free.
BLOCKS, WIDTH, DATA = 9, 7, 4
#: Fingerprints of one home anchor above which the anchor is split into cells.
CELL = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()  # bytes: A-Z only, and just these spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, text_hash): the fingerprint as a signed long, and Spark's hash of the text. No shuffle."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hold("simhash_dedup")
        got = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(got), b.column(2)], names=["id", "fp", "text_hash"])

    return map_batches(docs.select(id_col, text_col, text_hash(text_col).alias("_hash")), run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long, text_hash long")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.length(text_col), F.col(text_col))


def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 7-bit word: the codeword that covers it, and those that cover a word one flip away (-1: none)."""

    def nearest(w: int) -> int:
        syndrome = 0
        for i in range(WIDTH):
            if w >> i & 1:
                syndrome ^= i + 1
        return w if not syndrome else w ^ 1 << syndrome - 1

    codewords = sorted({nearest(w) for w in range(1 << WIDTH)})
    number = {w: i for i, w in enumerate(codewords)}
    home = np.array([number[nearest(w)] for w in range(1 << WIDTH)], np.uint64)
    near = [sorted({number[nearest(w ^ 1 << i)] for i in range(WIDTH)} - {int(home[w])}) for w in range(1 << WIDTH)]
    most = max(map(len, near))
    return home, np.array([x + [-1] * (most - len(x)) for x in near], np.int64)


HOME, NEAR = code_tables()


def home_anchor(fp: np.ndarray) -> np.ndarray:
    """The anchor whose ball holds each fingerprint."""
    out = np.zeros(len(fp), np.uint64)
    for i in range(BLOCKS):
        out |= HOME[(fp >> np.uint64(WIDTH * i)) & np.uint64(127)] << np.uint64(DATA * i)
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all anchors that a fingerprint goes to.

    Each partner of a pair takes half of the threshold: two fingerprints within 2 bits have one between them,
    within 1 bit of both, and both go to the anchor that covers it, which is within the covering radius plus
    the threshold of either. So a fingerprint goes to every anchor that covers it or a word one flip away:
    28 at most.
    """
    home = home_anchor(fp)
    rows, out = [np.arange(len(fp))], [home]
    for i in range(BLOCKS):
        word = ((fp >> np.uint64(WIDTH * i)) & np.uint64(127)).astype(np.int64)
        for j in range(NEAR.shape[1]):
            other = NEAR[word, j]
            at = np.flatnonzero(other >= 0)
            rows.append(at)
            out.append(home[at] ^ ((HOME[word[at]] ^ other[at].astype(np.uint64)) << np.uint64(DATA * i)))
    return np.concatenate(rows), np.concatenate(out)


def linked(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges among rows sorted by key: fingerprints of one key that chains of links join share a root."""
    n = len(fp)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at, k = np.arange(n - 1), 1
    while len(at):
        at = at[at + k < n]
        at = at[key[at] == key[at + k]]  # a row without a partner at this distance has none farther
        near = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= most]
        for i in near[root[near] != root[near + k]].tolist():
            a, b = find(i), find(i + k)
            if a != b:
                root[max(a, b)] = min(a, b)
        k += 1
    while (root[root] != root).any():
        root = root[root]
    own = np.flatnonzero(root != np.arange(n))
    return fp[own], fp[root[own]]


def near_pairs(fps: DataFrame, most: int = THRESHOLD) -> DataFrame:
    """Star edges (a, b) that join all distinct fingerprints `fp` which chains of links of at most `most` bits join.

    Only thresholds up to 2 are covered. Anchors that are home to more than CELL fingerprints are split into cells,
    one for each pair of blocks of their fingerprints, so no task holds more than a bounded number of rows; every
    pair still meets in some cell. The list of split anchors is broadcast only up to BROADCAST_ROWS of them. An
    anchor gives one edge a fingerprint at most, never all its pairs.
    """
    if most > THRESHOLD:
        raise ValueError("the anchors cover thresholds up to 2")

    def at_home(b: pa.RecordBatch) -> pa.RecordBatch:
        got = home_anchor(b.column(0).to_numpy().view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(got.view(np.int64))], names=["anchor"])

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = b.column(0).to_numpy().view(np.uint64)
        rows, anchor = anchors(fp)
        return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[rows].view(np.int64))], names=["anchor", "fp"])

    homes = map_batches(fps.select("fp"), at_home, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    crowded = settle(homes.select("anchor", F.ceil(F.col("n") / CELL).cast("long").alias("parts")))
    few = crowded.count() <= BROADCAST_ROWS
    placed = map_batches(fps.select("fp"), place, "anchor long, fp long").join(F.broadcast(crowded) if few else crowded, "anchor", "left")
    own, parts, other = F.pmod(F.xxhash64("fp"), F.col("parts")), F.col("parts"), F.col("other")
    every = F.when(parts.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
    cell = F.when(parts.isNull(), F.lit(0).cast("long")).otherwise(F.least(own, other) * parts + F.greatest(own, other))
    placed = placed.withColumn("other", F.explode(every)).select("anchor", cell.alias("cell"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None

        def solve(anchor: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.r_[False, (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])]
            a, b = linked(np.cumsum(new), fp.view(np.uint64), most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for b in batches:
            now = tuple(b.column(i).to_numpy() for i in range(3))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last key may go on in the next batch
            if cut:
                yield solve(*(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
        if held is not None and len(held[0]):
            yield solve(*held)

    return apply(placed.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell"), compare, "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable).

    Equal fingerprints are one node before anything is compared, so copies cost nothing; nodes go to anchors,
    are compared there, and distributed union-find joins the links. Null and blank texts have fingerprint zero
    and link like any other. Null ids: component_id is the smallest other id of the component, null if none.
    Repeated rows get the same component. Texts of any length are hashed whole. An empty table gives no rows.
    Other columns are not read.
    """
    prints = settle(fingerprints(docs, id_col, text_col, shingle).drop("text_hash"))
    nodes = settle(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")))
    member = _roots(nodes, most)
    total = prints.count()
    lows = settle(member.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("size")))
    member = settle(attach_groups(member, lows, "root", "size", total).select("fp", "n", "component_id"))
    out = attach_groups(prints, member, "fp", "n", total)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _roots(nodes: DataFrame, most: int) -> DataFrame:
    """nodes with the column root: the smallest fingerprint that links reach from `fp`."""
    parts = components(near_pairs(nodes, most))
    return settle(nodes.join(parts, nodes.fp == parts.node, "left").select(*nodes.columns, F.coalesce("component", "fp").alias("root")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are not the first of their component: the smallest id, null ids last, then the
    smallest fingerprint and text hash. Decided by row, not by id; rows equal in id and text stay once. Null and
    blank texts have fingerprint zero and so stay once together. All columns pass; an empty table gives no rows."""
    prints = settle(fingerprints(docs, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "text_hash")).alias("first")
    nodes = settle(prints.groupBy("fp").agg(first))
    stay = _roots(nodes, THRESHOLD).groupBy("root").agg(F.min("first").alias("first"))
    stay = settle(stay.select(F.col("first.id").alias("_stay"), F.col("first.text_hash").alias("_stay_hash")))
    kept = docs.join(stay, F.col(id_col).eqNullSafe(F.col("_stay")) & (text_hash(text_col) == F.col("_stay_hash")), "left_semi")
    rows = prints.join(stay, F.col("id").eqNullSafe(F.col("_stay")) & (F.col("text_hash") == F.col("_stay_hash")), "left_semi")
    if rows.count() == stay.count():
        return kept
    return kept.withColumn("_hash", text_hash(text_col)).dropDuplicates([id_col, "_hash"]).select(*docs.columns)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash_dedup": op8_simhash_dedup}
