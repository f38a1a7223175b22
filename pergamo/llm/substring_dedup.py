"""Substring deduplication by seed and extend on winnowed anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamo.llm.common import CHUNK, apply, chunks, map_batches, mix64, table
from pergamo.plans.bitmap import BUCKET, filter_bits
from pergamo.plans.skew import attach_groups
from pergamo.session import settle

#: Words of a window that counts as a repeat, and of a seed.
WINDOW, SEED = 13, 5
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Removed runs, of all documents together, that are broadcast to the last pass; more of them are joined by a shuffle.
BROADCAST_RUNS = 2_000_000
#: Copies of whole texts, in rows of 16 bytes, that are broadcast; more of them are joined by a shuffle.
BROADCAST_COPIES = 1_000_000


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i mod 2^64 for i < n, and a random number for each byte."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down), np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, index of each text's first word and, last, the number of words)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    up, down, value = _powers(1 << max(20, (len(buf)).bit_length()))
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[buf] * up[: len(buf)], dtype=np.uint64)])
    words = mix64((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return words, np.searchsorted(starts, first)


def _grams(words: np.ndarray, n: int, salt: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        out += words[j : j + len(out)] * np.uint64(pow(0xC2B2AE3D27D4EB4F + 2 * salt, j + 1, 1 << 64))
    return mix64(out)


def seeded_windows(texts: list[bytes], window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """For every window: the text it is in, its first word there, the position of its seed, and the words and seed hashes.

    The seed of a window is the first of its seed-word grams whose hash is smallest, so equal windows have equal
    seeds wherever they stand (winnowing), and neighbouring windows mostly share theirs.
    """
    words, first = word_hashes(texts)
    grams = _grams(words, seed, 1)
    n = np.diff(first)
    per = np.maximum(0, n - window + 1)
    of = np.repeat(np.arange(len(texts)), per)
    start = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    at = first[:-1][of] + start
    if not len(at):
        return of, start, at, words, grams
    low = grams[at]
    pick = at.copy()
    for j in range(1, window - seed + 1):
        here = grams[at + j]
        less = here < low
        low[less] = here[less]
        pick[less] = at[less] + j
    return of, start, pick, words, grams


def _batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts of documents long enough to have a window and with an id."""
    for b in batches:
        texts = b.column(1).to_pylist()
        for a, e in chunks(texts, CHUNK // 4):
            own = [i for i in range(a, e) if texts[i] and len(texts[i]) >= 2 * window - 1]
            if own:
                yield b.column(0).take(pa.array(own)), [texts[i].encode("utf-8", "surrogatepass") for i in own]


def seeds(docs: DataFrame, kind: str, window: int) -> DataFrame:
    """(seed, id): the distinct seeds of each document, about a fifth as many as its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches, window):
            of, _, pick, _, grams = seeded_windows(texts, window)
            new = np.r_[True, pick[1:] != pick[:-1]] if len(pick) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(grams[pick[new]].view(np.int64)), ids.take(pa.array(of[new]))], names=["seed", "id"])

    return apply(docs, run, f"seed long, id {kind}")


def seed_filter(shared: DataFrame, bits: int) -> bytes:
    """A Bloom filter of the shared seeds, two places each; 2^bits bits, 64 MB at most."""
    low, high = F.col("seed"), F.shiftrightunsigned("seed", 64 - bits)
    place = F.explode(F.array(low.bitwiseAND(F.lit((1 << bits) - 1)), high))
    rows = shared.select(place.alias("p")).groupBy(F.shiftright("p", BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << BUCKET) - 1))).alias("bitmap"))
    out = bytearray(1 << (bits - 3))
    size = 1 << (BUCKET - 3)
    for r in rows.toLocalIterator():
        out[r["bucket"] * size : (r["bucket"] + 1) * size] = r["bitmap"]
    return bytes(out)


def windows(docs: DataFrame, kind: str, window: int, bits: int, filter_: bytes) -> DataFrame:
    """(w1, w2, id, start): windows whose seed may stand in another document too; 128 bits name their words."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)

        def holds(p: np.ndarray) -> np.ndarray:
            return (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for ids, texts in _batches(batches, window):
            of, start, pick, words, grams = seeded_windows(texts, window)
            seed = grams[pick]
            ok = holds(seed & np.uint64((1 << bits) - 1)) & holds(seed >> np.uint64(64 - bits))
            if not ok.any():
                continue
            _, first = word_hashes(texts)
            at = first[:-1][of[ok]] + start[ok]
            w1, w2 = _grams(words, window, 2)[at], _grams(words, window, 3)[at]
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), ids.take(pa.array(of[ok])), pa.array(start[ok].astype(np.int32))], names=["w1", "w2", "id", "start"])

    return apply(docs, run, f"w1 long, w2 long, id {kind}, start int")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, starts, ends): maximal runs of words of a document that repeat smaller documents, `window` words at least.

    Seed: a first pass takes the winnowed seeds of every document; the seeds that two documents have are counted
    with a combine before the shuffle. Extend: a second pass widens each shared seed to both sides, to every
    window of the document that has it as its seed, and only these windows meet by their words. A window repeats
    if a smaller id has it as well. Windows that overlap or touch merge to maximal runs. Texts never shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = seeds(docs, kind, window).groupBy("seed").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("seed")
    shared = settle(shared)
    bits = filter_bits(shared.count())
    met = settle(windows(docs, kind, window, bits, seed_filter(shared, bits)))
    first = settle(met.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("w1", "w2", "low"))
    repeats = met.join(first, ["w1", "w2"]).where("id > low").groupBy("id").agg(F.collect_list("start").alias("at"))

    def merge(b: pa.RecordBatch) -> pa.RecordBatch:
        starts, ends = [], []
        for at in b.column(1):
            x = np.unique(at.values.to_numpy())
            cut = np.flatnonzero(np.diff(x) > window)
            starts.append(x[np.r_[0, cut + 1]].tolist())
            ends.append((x[np.r_[cut, len(x) - 1]] + window).tolist())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["id", "starts", "ends"])

    return map_batches(repeats, merge, f"id {kind}, starts array<int>, ends array<int>")


def later_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(copy_id, copy_hash): ids, with a hash of the text, of texts that a smaller id has as a whole."""
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("sha"), F.xxhash64(text_col).alias("copy_hash")).where("id is not null and sha is not null")
    low = rows.groupBy("sha").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    rows, low = settle(rows), settle(low)
    found = attach_groups(rows, low, "sha", "n", rows.count()).where("id > low")
    return found.select(F.col("id").alias("copy_id"), "copy_hash").distinct()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Words in repeated_runs() go. A text that a smaller id has as a whole goes from a window's length on, so only
    the first of equal texts is searched. Windows are judged on the input, not on what is left. What stays is
    joined by one space. Null texts have no words. Rows with a null id lose nothing and nothing is lost to them. Rows that
    share an id lose nothing to each other, and each loses the runs found for that id. Documents of fewer words
    than a window lose nothing. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(id_col, text_col)
    copies = settle(later_copies(docs, id_col, text_col))
    few = (lambda df: F.broadcast(df)) if copies.count() <= BROADCAST_COPIES else (lambda df: df)
    is_copy = (F.col("copy_id") == F.col(id_col)) & (F.col("copy_hash") == F.xxhash64(text_col))
    runs = settle(repeated_runs(docs.join(few(copies), is_copy, "left_anti"), id_col, text_col, window))
    n = runs.agg(F.sum(F.size("starts"))).first()[0] or 0
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col), F.col(text_col)).join(few(copies), is_copy, "left").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("copy_id").isNotNull().alias("copy"))
    found = found.join(F.broadcast(runs) if n <= BROADCAST_RUNS else runs, "id", "left").select("id", "text", "starts", "ends", "copy")

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, starts, ends, copy in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            n, kept, at = len(words), [], 0
            if copy and n >= window:
                starts, ends = [0], [n]
            for a, e in zip(starts or (), ends or ()):
                kept += words[at:a]
                at = e
            kept += words[at:]
            left = b" ".join(kept)
            rows.append((n, n - len(kept), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if keep_text else None))
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + keep_text])]
        return pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + keep_text])

    return map_batches(found, cut, f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text).withColumnRenamed("id", id_col)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
