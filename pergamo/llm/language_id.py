"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamo.llm.common import apply, chunks, hold, map_batches, mix64, table
from pergamo.session import settle

#: Hash buckets, n-gram lengths, additive smoothing; labelled rows that training reads, in expectation; languages
#: that are learned at most, the most frequent ones: the model has BUCKETS x MOST_LANGS numbers, 64 MB, whatever the data.
BUCKETS, LENGTHS, SMOOTH, FIT_ROWS, MOST_LANGS = 1 << 16, (1, 2, 3), 0.1, 20_000, 256
UNKNOWN = "und"
#: Characters that are hashed at once: a longer text is scored in runs, which bounds the arrays beside it.
RUN = 500_000
LETTER = regex.compile(r"\p{L}")


def runs(texts: list[str], n: int) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, parts): the texts, lower-cased and framed by spaces, in parts that have each n-gram once, RUN
    characters or so at a time; row numbers repeat where a text is in several parts."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        t = f" {t.lower()} "
        for a in range(0, max(1, len(t) - n + 1), RUN):
            part = t[a : a + RUN + n - 1]
            if rows and size + len(part) > RUN:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, parts


def hashed_ngrams(framed: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, start of each text's run)."""
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum([0, *map(len, framed)])
    h = codes.copy()
    for k in range(1, n):
        h[:-k] = h[:-k] * np.uint64(0x100000001B3) + codes[k:]
        if k < len(h):
            h[-k:] = 0
    at = (mix64(h + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int32)
    for k in range(1, n):  # those that would run into the next text
        at[starts[1:] - k] = BUCKETS
    return at, starts[:-1]


class Model:
    """Log probabilities: one row a bucket and one more, of zeros, for what doesn't count."""

    def __init__(self, langs: list[str], counts: np.ndarray, rows: np.ndarray) -> None:
        self.langs = langs
        p = np.log(counts + SMOOTH) - np.log(counts.sum(0, keepdims=True) + SMOOTH * BUCKETS)
        self.table = np.vstack([p, np.zeros((1, len(langs)))]).astype(np.float32)
        self.prior = np.log(rows / rows.sum())

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log posterior, up to a constant, of each text and language."""
        out = np.tile(self.prior, (len(texts), 1))
        for n in LENGTHS:
            for rows, parts in runs(texts, n):
                at, starts = hashed_ngrams(parts, n)
                np.add.at(out, rows, np.add.reduceat(self.table[at], starts, axis=0, dtype=np.float64))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, score = [], []
        for a, b in chunks(texts, RUN):
            real = [i for i in range(a, b) if texts[i] and LETTER.search(texts[i])]
            here = {i: (UNKNOWN, 0.0) for i in range(a, b)}
            if real and self.langs:
                s = self.scores([texts[i] for i in real])
                best = s.argmax(1)  # a tie goes to the language first by code point
                p = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
                here |= {i: (self.langs[k], float(x)) for i, k, x in zip(real, best, p)}
            for lang, x in here.values():
                langs.append(lang)
                score.append(x)
        return langs, score


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Train on the labelled rows, or on about fit_rows of them, chosen by a hash of the text, if there are more.

    Each task counts n-grams in arrays of fixed size; sums over tasks are BUCKETS x languages numbers.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    n = rows.select("lang").count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))

    def count(batches):
        hold("language_id")
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, e in chunks(texts, RUN):
                for lang in {*langs[a:e]}:
                    own = [texts[i] for i in range(a, e) if langs[i] == lang]
                    acc = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    for k in LENGTHS:
                        for _, parts in runs(own, k):
                            acc[:BUCKETS] += np.bincount(hashed_ngrams(parts, k)[0], minlength=BUCKETS + 1)[:BUCKETS]
                    acc[BUCKETS] += len(own)
        for lang, acc in sums.items():
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(acc[at])], names=["lang", "bucket", "n"])

    got = apply(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = settle(got)
    known = got.where(F.col("bucket") == BUCKETS).orderBy(F.desc("n"), "lang").select("lang").limit(MOST_LANGS)
    langs = sorted(r.lang for r in known.collect())
    place, counts = {x: i for i, x in enumerate(langs)}, np.zeros((BUCKETS + 1, len(langs)))
    by_lang = got.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).select("lang", "x.bucket", "x.n")
    for lang, at, n in by_lang.where(F.col("lang").isin(langs)).toLocalIterator() if langs else ():  # a row of BUCKETS + 1 numbers at most
        counts[at, place[lang]] = n
    return Model(langs, counts[:BUCKETS], counts[BUCKETS])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns in `keep`, lang_pred and score (posterior probability, 0 to 1).

    Whole texts are scored; the model is broadcast (BUCKETS x languages floats, at most 64 MB). Null texts and
    those without a letter, and all texts where nothing was learned, are `und` with score 0. Ties go to the
    language first by code point. No shuffle; null and repeated ids pass through; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep)]

    def predict(b: pa.RecordBatch) -> pa.RecordBatch:
        hold("language_id")
        langs, score = shared.value.predict(b.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[id_col, *keep, "lang_pred", "score"])

    picked = docs.select(F.col(text_col).alias("_text"), id_col, *keep)
    return map_batches(picked, predict, ", ".join([*fields, "lang_pred string, score double"]))


def held_out(id_col: str = "doc_id"):
    """Rows that training must not see."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_known(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs, with all their columns, without those whose language is `und`; trained on the rows not held out.

    Where nothing was learned, only null texts and those without a letter go. Null and repeated ids, repeated
    rows and texts of any length pass or go by their text alone; an empty table gives no rows."""
    model = fit(docs.where(~held_out(id_col)))
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    learned = bool(model.langs)

    def keep(batches):
        hold("language_id")
        for b in batches:
            texts = b.column(at).to_pylist()
            known = [x != UNKNOWN for x in shared.value.predict(texts)[0]] if learned else [bool(t and LETTER.search(t)) for t in texts]
            yield b.filter(pa.array(known, pa.bool_()))

    return apply(docs, keep, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
