"""Spelling variants: words one edit apart, found in the sorted permuterm rotations of the vocabulary."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamo.llm.common import apply, table
from pergamo.session import settle

#: A letter, as a character class; shortest word in letters and its least occurrences; times a form is more frequent than its variant.
LETTER, SHORTEST, LEAST, TIMES = "[A-Za-zÀ-ÿ]", 7, 2, 10
#: One run in so many loses a letter before words are counted.
SPOILED = 31
#: Letters of a rotation that its sort key holds as they are; a longer rotation adds a hash of the whole.
HEAD = 32
#: Rows of rotations made at once.
SLICE = 50_000
#: What ends a word in its rotations; letters have other bytes in Latin-1, and 0 fills up short keys.
END = 1
FULL, SKIP, SKIP_FIRST = 0, 1, 2
PRIMES, BASE = (2_147_483_647, 2_147_483_629), 1_000_003


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least SHORTEST letters that occur LEAST times or more. JVM functions only.

    A run of letters of the whole text, A-Z lower-cased, is a word; one in SPOILED, chosen by the crc32 of
    "<id>:<run>", loses the letter at that crc32 modulo its length. Runs are counted in each task before they shuffle,
    so a word that holds a third of all runs costs a row a task. Null texts have no runs; a null id counts as an
    empty one.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTER}{{{SHORTEST},}}+"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % SPOILED == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)


def _powers(base: int, n: int, p: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo p, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), p) % p])
    return out[:n]


def _window_hashes(twice: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start: 62 bits of two polynomial hashes of twice[start : start + length], in time linear in twice."""
    out = np.zeros(len(starts), np.int64)
    for p in PRIMES:
        up, down = _powers(BASE, len(twice), p), _powers(pow(BASE, -1, p), len(twice), p)
        sums = np.concatenate([[0], np.cumsum(twice.astype(np.int64) * up % p)])
        out = out << 31 | (sums[starts + length] - sums[starts]) % p * down[starts] % p
    return out


def rotations(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, number of the word, kind) of all rotations, SLICE rows at most at a time.

    A word w of L letters with its end mark has L + 1 rotations w[i:] $ w[:i]. Each is a key as it stands (FULL), and each
    that ends in a letter is one without that letter (SKIP): the prefix range of all that differ from w there. Two words of one
    SKIP key are a replacement apart. A word whose FULL key is the SKIP key of another is that one without a letter;
    of a run of equal letters any could be the missing one, so only its first has the kind SKIP_FIRST, and a pair
    meets once. A key has HEAD bytes, then, for rotations longer than these, a hash of the whole of it, so a
    word of a million letters has rows as short as any.
    """
    coded = [w.encode("latin-1") for w in words]
    at = 0
    while at < len(coded):
        end, size = at, 0
        while end < len(coded) and (end == at or size + 2 * len(coded[end]) + 1 <= SLICE):
            size += 2 * len(coded[end]) + 1
            end += 1
        yield from _rotations_of(coded[at:end], at)
        at = end


def _rotations_of(coded: list[bytes], first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    mark = bytes([END])
    flat = np.frombuffer(b"".join(w + mark + w + mark for w in coded) + bytes(HEAD), np.uint8)
    length = np.array([len(w) for w in coded], np.int64)
    offset = np.concatenate([[0], np.cumsum(2 * length + 2)[:-1]])
    rows = 2 * length + 1
    ends = np.cumsum(rows)
    windows = np.lib.stride_tricks.sliding_window_view(flat, HEAD)
    hashes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in np.flatnonzero(length + 1 > HEAD).tolist():
        n, twice = int(length[i]), flat[offset[i] : offset[i] + 2 * length[i] + 2]
        hashes[i] = _window_hashes(twice, np.arange(n + 1), n + 1), _window_hashes(twice, np.arange(1, n + 1), n)
    for low in range(0, int(ends[-1]), SLICE):
        row = np.arange(low, min(low + SLICE, int(ends[-1])))
        word = np.searchsorted(ends, row, side="right")
        nth = row - (ends[word] - rows[word])
        n = length[word]
        skip = nth > n
        cut = np.where(skip, nth - n - 1, nth)  # the letter skipped, or where the rotation begins
        start = offset[word] + cut + skip
        size = n + 1 - skip
        key = np.zeros((len(row), HEAD + 8), np.uint8)
        key[:, :HEAD] = np.where(np.arange(HEAD) < size[:, None], windows[start], 0)
        for i in sorted(hashes.keys() & set(word.tolist())):
            mine = np.flatnonzero(word == i)
            full, less = hashes[i]
            rest = np.where(skip[mine], less[np.minimum(cut[mine], len(less) - 1)], full[cut[mine]])
            key[mine, HEAD:] = rest.astype(">i8").view(np.uint8).reshape(-1, 8)
        again = skip & (cut > 0) & (flat[offset[word] + cut] == flat[offset[word] + cut - 1])
        yield key, word + first, np.where(skip, np.where(again, SKIP, SKIP_FIRST), FULL).astype(np.int32)


def _rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, counts = b.column(0).to_numpy(), b.column(2).to_numpy()
        for key, word, kind in rotations(b.column(1).to_pylist()):
            offsets = np.arange(len(key) + 1, dtype=np.int32) * (HEAD + 8)
            keys = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets), pa.py_buffer(key)])
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids[word]), pa.array(counts[word]), pa.array(kind)], names=["key", "id", "n", "kind"])


def neighbours(group: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(id, near words, n and id of the best of them) from (n, id, kind) of the rows of one key, in any order.

    A key has 90 SKIP rows at most, one a letter of the alphabet, and one FULL row at most, as words are distinct.
    """
    rows = sorted((-n, i, kind) for n, i, kind in group)
    skips = [r for r in rows if r[2] != FULL]
    first = [r for r in skips if r[2] == SKIP_FIRST]
    full = [r for r in rows if r[2] == FULL]
    for r in skips:
        near = len(skips) - 1 + (len(full) if r[2] == SKIP_FIRST else 0)
        others = ([skips[0] if r is not skips[0] else skips[1]] if len(skips) > 1 else []) + (full if r[2] == SKIP_FIRST else [])
        if others:
            best = min(others)
            yield r[1], near, -best[0], best[1]
    if full and first:
        yield full[0][1], len(first), -first[0][0], first[0][1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key; the rows of the last key wait for the next batch."""
    width = HEAD + 8
    held = np.zeros((0, width), np.uint8), np.zeros((0, 3), np.int64)

    def found(keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        change = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]])
        starts = np.flatnonzero(change)
        several = np.flatnonzero(np.diff(starts) > 1)
        out = [x for i in several.tolist() for x in neighbours(rows[starts[i] : starts[i + 1]].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [], []))], names=["id", "near", "best_n", "best"])

    for b in batches:
        if not b.num_rows:
            continue
        data = b.column(0)
        begin = np.frombuffer(data.buffers()[1], np.int32)[data.offset]
        keys = np.frombuffer(data.buffers()[2], np.uint8)[begin : begin + b.num_rows * width].reshape(-1, width)
        keys = np.concatenate([held[0], keys])
        rows = np.concatenate([held[1], np.stack([b.column(i).to_numpy().astype(np.int64) for i in (2, 1, 3)], 1)])
        open_ = int(np.flatnonzero((keys != keys[-1]).any(1))[-1]) + 1 if (keys != keys[-1]).any() else 0
        if open_:
            yield found(keys[:open_], rows[:open_])
        held = keys[open_:], rows[open_:]
    if len(held[0]):
        yield found(*held)


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """One row per word of words (word, n): word, form, root, n, n_near, form_n.

    words: distinct words of Latin letters with their counts. Near words differ by exactly one inserted, deleted or replaced
    letter. The form is the near word of largest n (ties: the smallest in code-point order) if that n is
    at least `times` times the word's own; the root is where forms lead.

    Words get numbers in code-point order. Their rotations are sorted by range, and a scan of each task's sorted
    rows meets all words of a key: 91 at most, since a key fixes all letters but one. Of these only each word's count of neighbours
    and its best one leave the task, never the pairs. A form is `times` times as frequent as the word, so
    a chain of forms is short, and pointer jumping ends in a few rounds. Rows are as short for a word of a million letters as for any
    other (see `rotations`). Null words and counts are left out; an empty table gives no rows.
    """
    numbered = settle(words.where("word is not null and n is not null").orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", F.col("n").cast("long").alias("n")))
    turned = apply(numbered, _rotate, "key binary, id long, n long, kind int").repartitionByRange("key").sortWithinPartitions("key")
    near = apply(turned, _scan, "id long, near long, best_n long, best long")
    near = near.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("back"))).alias("top"))
    near = settle(near.select("id", "n_near", F.col("top.best_n").alias("best_n"), (-F.col("top.back")).alias("best")))
    known = numbered.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best_n") >= times * F.col("n"), F.col("best")).alias("form_id"))
    known = settle(known)
    forms = known.where("form_id is not null")
    hops = forms.select("id", F.col("form_id").alias("root_id"))
    ends = forms.select(F.col("id").alias("root_id"))
    while not hops.join(ends, "root_id", "left_semi").isEmpty():
        on = hops.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        hops = settle(hops.join(on, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id")))
    named = lambda key, word, n: numbered.select(F.col("id").alias(key), F.col("word").alias(word), F.col("n").alias(n))
    linked = known.where("form_id is not null").join(named("form_id", "form", "form_n"), "form_id").join(hops, "id").join(named("root_id", "root", "root_n"), "root_id").select("word", "form", "root", "n", "n_near", "form_n")
    alone = known.where("form_id is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return linked.unionByName(alone)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents; nulls, ties, repeats and long texts as the two functions above state."""
    return spelling_variants(counted_words(table(spark, sf_dir, "documents")))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
