"""Exact token counts at every prefix of a text, by a dynamic program over prefixes."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pergamo.llm.bpe_core import CACHE, Kept, Merges
from pergamo.llm.common import CHUNK, chunks, hold, map_batches, table

#: How a byte-level tokenizer cuts a text before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same cuts where all characters are ASCII, for the faster engine.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Pieces whose prefixes are cut otherwise than the piece.
CONTRACTIONS = ("'re", "'ve", "'ll")
SPACES = regex.compile(r"\s{2,}(?=\S)")
LIMIT = 1024


class PrefixCounter:
    """Token counts of all character prefixes of texts; pieces are solved once and kept."""

    def __init__(self, model: Merges) -> None:
        self.model = model
        self.steps = Kept()

    def learn(self, pieces: set[str]) -> None:
        """Solve the new ones in the order of their symbols: what two neighbours begin with is solved once."""
        symbols, step = self.model.symbols, self.model.last_token
        before, last, count = "", [-1], [0]
        for s, piece in sorted([(symbols(p), p) for p in pieces if self.steps[p] is None]):
            same = 0
            for x, y in zip(s, before):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for d in range(same + 1, len(s) + 1):
                t, n = step(s, d, last)
                last.append(t)
                count.append(count[d - n] + 1)
            before = s
            self.steps.put(piece, self._steps_of(piece, count))

    @staticmethod
    def _steps_of(piece: str, count: list[int]) -> bytes:
        """By how much each further character of a piece changes the count, as int32 bytes; count is by symbols."""
        if len(count) > len(piece) + 1:  # only whole characters end prefixes
            ends = [0]
            for c in piece:
                ends.append(ends[-1] + len(c.encode()))
            count = [count[e] for e in ends]
        out = array("i", map(sub, count[1:], count))
        if piece in CONTRACTIONS:  # the prefix of two characters is two pieces
            out[1], out[2] = 1, count[3] - 2
        return out.tobytes()

    def _step(self, piece: str) -> bytes:
        out = self.steps[piece]
        if out is None:
            self.learn({piece})
            out = self.steps[piece]
        return out

    def _plain(self, text: str, pieces: list[str] | None = None) -> np.ndarray:
        """Counts of the prefixes of length 1, 2, ... of a text without special strings."""
        kept, pieces = self.steps, cut(text) if pieces is None else pieces
        out = np.frombuffer(b"".join([kept[p] or self._step(p) for p in pieces]), np.int32).cumsum(dtype=np.int64)
        for m in SPACES.finditer(text):  # a prefix that ends here has the run as one piece
            a, b = m.span()
            out[b - 1] = (out[a - 1] if a else 0) + np.frombuffer(self._step(text[a:b]), np.int32).sum()
        return out

    def counts(self, text: str, pieces: list[str] | None = None) -> np.ndarray:
        """counts[i]: tokens of text[:i], as the tokenizer library counts them; pieces: of cut(), if known."""
        parts = self.model.segments(text)
        if len(parts) == 1:
            return np.concatenate([np.zeros(1, np.int64), self._plain(text, pieces)])
        out, base = [np.zeros(1, np.int64)], 0
        for i in range(0, len(parts), 2):
            here = self._plain(parts[i])
            out.append(base + here)
            whole = base + (here[-1] if len(here) else 0)
            if i + 1 < len(parts):  # within a special string its beginning is ordinary text
                special = parts[i + 1]
                within = [self._plain(parts[i] + special[:k])[-1] for k in range(1, len(special))]
                out.append(np.array([base + x for x in within] + [whole + 1], np.int64))
                whole += 1
            base = whole
        return np.concatenate(out)


    def all_counts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """counts() of each text, what is new in all of them learned together; texts should be a few MB."""
        cuts = [cut(t) for t in texts]
        pieces: set[str] = set()
        for c in cuts:
            pieces.update(c)
            if len(pieces) > CACHE // 4:
                self.learn(pieces)
                pieces.clear()
        self.learn(pieces)
        return map(self.counts, texts, cuts)


def cut(text: str) -> list[str]:
    return (ASCII_PIECES if text.isascii() else PIECES).findall(text)


def counter(source: str) -> PrefixCounter:
    """That of this worker process, built once."""
    return hold("token_counts", source, lambda: PrefixCounter(Merges(source)))


def token_counts(docs: DataFrame, tokenizer: str, budget: int = LIMIT, keep_prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, n_bytes, n_tokens, fit_chars and, if asked for, prefix_tokens.

    tokenizer: path of a byte-level BPE .json file, read on the driver and broadcast (a few MB, whatever the
    input). fit_chars: length of the longest prefix with at most `budget` tokens. prefix_tokens: the count at
    every prefix, element 0 for the empty one, so that any truncation is a lookup. No shuffle. Null text counts
    as empty; null and repeated ids pass through; other columns are not read; an empty table gives no rows.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(shared.value)
        rows, texts = [], [t or "" for t in b.column(1).to_pylist()]
        for a, e in chunks(texts, CHUNK // 2):
            for t, n in zip(texts[a:e], c.all_counts(texts[a:e])):
                fit = len(t) if n[-1] <= budget else int(np.flatnonzero(n <= budget)[-1])
                rows.append((len(t), len(t.encode()), int(n[-1]), fit, n.astype(np.int32) if keep_prefixes else None))
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        names = ["id", "n_chars", "n_bytes", "n_tokens", "fit_chars"]
        if keep_prefixes:
            return pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([r[4] for r in rows], pa.list_(pa.int32()))], names=[*names, "prefix_tokens"])
        return pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(id_col, text_col), count, f"id {kind}, n_chars long, n_bytes long, n_tokens long, fit_chars long" + ", prefix_tokens array<int>" * keep_prefixes)
    return out.withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and the longest prefix that fits, for all documents."""
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {LIMIT} as over_limit", "fit_chars")


QUERIES = {"op1_token_counts": op1_token_counts}
