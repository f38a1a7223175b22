"""Document fingerprints: every shingle hash below a fixed fraction of all hashes, as a string that can be merged and compared."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamo.llm.common import apply, mix64, table
from pergamo.session import settle, ship_code

#: Words of a shingle; share of all hashes that a fingerprint keeps; hashes that it keeps at least, where a text has as many.
SHINGLE, FRACTION, LEAST = 5, 1 / 8, 128
#: A hash has so many bits, and so many hex digits in a fingerprint; WHOLE: every hash is kept.
BITS, DIGITS = 48, 12
WHOLE = (1 << BITS) - 1
#: Characters of text that a part of the documents in the order of their ids has, more or less; most parts.
PART, MOST_PARTS = 16_000_000, 100_000
#: Bytes hashed at once, and characters of text that a task holds beside one document.
CHUNK = 1_000_000
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words [^\\x20\\x09-\\x0D]+ of data. A word's hash depends on its bytes only."""
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    up, down = _tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts] if len(starts) else np.zeros(0, np.uint64)
    return mix64(value + (ends - starts).astype(np.uint64)), starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of about CHUNK bytes that end where a word ends; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def _select(words: np.ndarray, shingle: int, fraction: float, least: int) -> tuple[int, np.ndarray]:
    """(threshold, sorted hashes up to it) of a text's word hashes."""
    k = min(shingle, len(words))
    if not k:
        return WHOLE, np.zeros(0, np.uint64)
    value = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        value = value * _STEP + words[i : i + len(value)]
    hashes = np.unique(mix64(value) >> np.uint64(64 - BITS))
    limit = int(fraction * (1 << BITS)) - 1
    below = int(np.searchsorted(hashes, np.uint64(limit), side="right"))
    if below >= least:
        return limit, hashes[:below]
    return (WHOLE, hashes) if len(hashes) <= least else (int(hashes[least - 1]), hashes[:least])


def sketches(texts: list[str], shingle: int = SHINGLE, fraction: float = FRACTION, least: int = LEAST) -> list[tuple[int, np.ndarray]]:
    """(threshold, hashes) of each text; texts are hashed together, CHUNK bytes at a time."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    out: list[tuple[int, np.ndarray]] = []
    at = 0
    while at < len(coded):
        if len(coded[at]) > CHUNK:
            out.append(_select(np.concatenate([word_hashes(p)[0] for p in _pieces(coded[at])]), shingle, fraction, least))
            at += 1
            continue
        end, size = at, 0
        while end < len(coded) and size + len(coded[end]) <= CHUNK:
            size += len(coded[end]) + 1
            end += 1
        hashes, starts = word_hashes(b" ".join(coded[at:end]))
        cuts = np.searchsorted(starts, np.cumsum([len(c) + 1 for c in coded[at:end]]))
        out += [_select(hashes[a:b], shingle, fraction, least) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
        at = end
    return out


def write_fingerprint(sketch: tuple[int, np.ndarray]) -> str:
    """The threshold, then the hashes up to it in order, DIGITS hex digits each."""
    numbers = np.concatenate([np.array([sketch[0]], np.uint64), sketch[1]]) << np.uint64(64 - BITS)
    return numbers.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes().hex()


def read_fingerprint(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, BITS // 8)
    numbers = np.zeros((len(raw), 8), np.uint8)
    numbers[:, 8 - BITS // 8 :] = raw
    at = numbers.view(">u8").ravel().astype(np.uint64)
    return int(at[0]), at[1:]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of their shingles that two texts have in common (Jaccard): of the hashes up to the lower of both
    thresholds. Exact where both sketches hold all hashes. Two without any hash: 1.0 if both texts are without words, else 0.0."""
    limit = np.uint64(min(a[0], b[0]))
    x, y = a[1][: np.searchsorted(a[1], limit, side="right")], b[1][: np.searchsorted(b[1], limit, side="right")]
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return both / either if either else float(len(a[1]) == len(b[1]) == 0)


def contained(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of the shingles of a that b has; the thresholds of unequal texts need not agree. Without words: 1.0."""
    limit = np.uint64(min(a[0], b[0]))
    x, y = a[1][: np.searchsorted(a[1], limit, side="right")], b[1][: np.searchsorted(b[1], limit, side="right")]
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else float(not len(a[1]))


def merge_fingerprints(fingerprints: Iterable[str]) -> str:
    """The fingerprint of the shingles of all: the union up to the lowest threshold. In any order, and merged ones merge again."""
    limit, held = WHOLE, np.zeros(0, np.uint64)
    for f in fingerprints:
        other, more = read_fingerprint(f)
        limit, held = min(limit, other), np.union1d(held, more)
        held = held[: np.searchsorted(held, np.uint64(limit), side="right")]
    return write_fingerprint((limit, held))


def _compare(one: Column | str, other: Column | str, how: str) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        from pergamo.llm import doc_fingerprints as D

        pairs = zip(a, b)
        return pd.Series([None if x is None or y is None else getattr(D, how)(D.read_fingerprint(x), D.read_fingerprint(y)) for x, y in pairs], dtype="float64")

    return run(one, other)


def likeness_of(one: Column | str, other: Column | str) -> Column:
    """`likeness` of two columns of fingerprints; a null gives a null. Workers need the package (`ship_code`)."""
    return _compare(one, other, "likeness")


def contained_in(one: Column | str, other: Column | str) -> Column:
    """`contained`: the share of the first column's text that the second's holds."""
    return _compare(one, other, "contained")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint), one row a document, without a shuffle. Null texts count as empty, repeated rows each; ids are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [write_fingerprint(s) for s in sketches([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=[id_col, "fingerprint"])

    return apply(docs.select(id_col, text_col), run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def merged_by(fingerprints: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint): one merged fingerprint a key, by built-in functions.

    Hashes are made distinct and cut at the key's lowest threshold before they meet, so what a key gathers is its own sketch: of a
    corpus, FRACTION of its distinct shingles. That grows with the key's documents; for whole corpora compare
    `hashes_of` by joins instead. Null fingerprints are left out.
    """
    parts = F.transform(F.sequence(F.lit(0), (F.length("fingerprint") / DIGITS - 1).cast("int")), lambda i: F.substring("fingerprint", (i * DIGITS + 1).cast("int"), F.lit(DIGITS)))
    x = fingerprints.where("fingerprint is not null").select(key, parts.alias("parts")).select(key, F.get("parts", F.lit(0)).alias("limit"), F.slice("parts", F.lit(2), F.size("parts")).alias("hashes"))
    limits = x.groupBy(key).agg(F.min("limit").alias("limit"))
    kept = x.select(F.col(key).alias("_key"), F.explode("hashes").alias("hash")).distinct()
    kept = kept.join(limits, F.col("_key").eqNullSafe(F.col(key))).where(F.col("hash") <= F.col("limit")).groupBy("_key").agg(F.array_sort(F.collect_list("hash")).alias("hashes"))
    return limits.join(kept, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.concat("limit", F.array_join(F.coalesce("hashes", F.array().cast("array<string>")), "")).alias("fingerprint"))


def hashes_of(fingerprints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, threshold, hash): fingerprints as rows, for joins on the hash."""
    digits = F.substring("fingerprint", 1, DIGITS)
    hashes = F.transform(F.sequence(F.lit(1), (F.length("fingerprint") / DIGITS - 1).cast("int")), lambda i: F.substring("fingerprint", (i * DIGITS + 1).cast("int"), F.lit(DIGITS)))
    return fingerprints.where(F.length("fingerprint") > DIGITS).select(id_col, digits.alias("threshold"), F.explode(hashes).alias("hash"))


ORDER = ["_none", "_rank", "_text", "_row"]


def in_order(docs: DataFrame, id_col: str, text_col: str, part_chars: int = PART) -> DataFrame:
    """(part, ghost, order columns, id, text): documents dealt to parts of descending ids, each with the first row of the next part.

    A pass over ids, lengths and hashes places the cuts, a few numbers a part that the driver holds; then whole
    texts shuffle once, by their part. The ghost row gives a part's last document its successor. Documents of one id are ordered by a hash
    of the text, so an id that very many rows share is cut as well.
    """
    keyed = docs.select(
        F.col(id_col).isNull().cast("int").alias("_none"), F.coalesce(F.bitwise_not(F.col(id_col).cast("long")), F.lit(0)).alias("_rank"), F.xxhash64(F.length(text_col), text_col).alias("_text"),
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"),
    )
    narrow = settle(keyed.select(*ORDER, F.length("text").alias("chars")))
    chars = narrow.agg(F.sum("chars")).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, chars // part_chars + 1))
    firsts = narrow.repartitionByRange(n, *ORDER).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*ORDER)).alias("first"))
    cuts = sorted(tuple(r["first"]) for r in firsts.collect())
    if not cuts:
        return keyed.select(F.lit(0).alias("part"), F.lit(0).alias("ghost"), *ORDER, "id", "text")

    @F.pandas_udf("int")
    def part_of(none: pd.Series, rank: pd.Series, text: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series([max(0, bisect_right(cuts, key) - 1) for key in zip(none.tolist(), rank.tolist(), text.tolist(), row.tolist())], dtype="int32")

    rows = keyed.withColumn("part", part_of(*ORDER)).withColumn("ghost", F.lit(0))
    heads = docs.sparkSession.createDataFrame([(*c, (i - 1) % len(cuts)) for i, c in enumerate(cuts)], "_none int, _rank long, _text long, _row long, part int")
    ghosts = keyed.join(F.broadcast(heads), ORDER).withColumn("ghost", F.lit(1))
    cols = ["part", "ghost", *ORDER, "id", "text"]
    return rows.select(cols).unionByName(ghosts.select(cols)).repartition(n, "part").sortWithinPartitions("part", "ghost", *ORDER)


def _edit(text: str, after: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, object, str]]]:
    """(part, ghost, id, text) in lists of some CHUNK characters; each list begins with the last row of the one before."""
    held: list[tuple[int, int, object, str]] = []
    size = 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(4))):
            held.append(row)
            size += len(row[3])
            if size > CHUNK:
                yield held
                held, size = held[-1:], len(row[3])
    if held:
        yield held


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_of_text.

    ids are integers. A document's successor is the next one by descending id (null ids last; rows of one id by a hash of the text; equal
    rows in any order, which does not show), the last one's is the first. The edited text has the last third of the code points replaced by the
    first as many of the successor's, or all if it has fewer. near_edited and near_next are likenesses of the
    fingerprint to the edited text's and to the successor's, kept_of_text the share of the text's shingles in the edited one.

    A fingerprint holds every hash of the text's five-word shingles (all words, if fewer) below FRACTION of all hashes,
    and at least the LEAST smallest; its threshold says up to where it is whole. So texts of up to LEAST shingles are held exactly, and
    two fingerprints compare up to the lower threshold, however unequal the texts. Equal texts have
    equal fingerprints. Null counts as empty; a text without words has no hashes. Texts are hashed whole, in pieces of
    CHUNK bytes. One row alone is its own successor; an empty table gives no rows. Other columns are not
    read. docs must give the same rows in the same tasks when it is read again, as tables do.
    """
    ship_code(docs.sparkSession)
    rows = in_order(docs, id_col, text_col).select("part", "ghost", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            pairs = [(a, b) for a, b in zip(block, block[1:]) if not a[1]]
            own = sketches([row[3] for row in block])
            edited = [_edit(a[3], b[3]) for a, b in pairs]
            changed = sketches(edited)
            near = [(own[i], own[i + 1]) for i, a in enumerate(block[:-1]) if not a[1]]
            yield pa.RecordBatch.from_pydict({
                id_col: [a[2] for a, _ in pairs], "n_chars": [len(a[3]) for a, _ in pairs], "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                "fingerprint": [write_fingerprint(x) for x, _ in near], "edited_fingerprint": [write_fingerprint(c) for c in changed],
                "near_edited": [likeness(x, c) for (x, _), c in zip(near, changed)], "near_next": [likeness(x, y) for x, y in near], "kept_of_text": [contained(x, c) for (x, _), c in zip(near, changed)],
            }, schema=schema)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([(id_col, {"int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kept_of_text", pa.float64())])
    return apply(rows, run, f"{id_col} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_of_text double")


def op12_doc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts; nulls, ties, repeats and long texts as `edited_likeness` states."""
    return edited_likeness(table(spark, sf_dir, "documents"))


QUERIES = {"op12_doc_fingerprints": op12_doc_fingerprints}
