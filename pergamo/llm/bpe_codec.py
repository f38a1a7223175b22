"""BPE encoding and decoding by one walk over a trie of the distinct words."""

from __future__ import annotations

import hashlib
import re
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pergamo.llm.bpe_core import CACHE, Kept, Merges, fold
from pergamo.llm.common import CHUNK, chunks, hold, map_batches, table

#: What the word tokenizer keeps of a text; all else separates.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
END = ""


def words_of(text: str) -> list[str]:
    text = fold(text)
    return (ASCII_WORDS if text.isascii() else WORDS).findall(text)


class TrieCodec:
    """Encodes words through a trie, so that a beginning which many words share is solved once.

    Each node is the dict of its children, by symbol; END leads to the words that stop there. The walk goes
    depth first with one stack of last tokens for the path above: entering a node sets the state of its depth
    from the states of its ancestors, and all words below reuse them.
    """

    def __init__(self, model: Merges) -> None:
        self.model = model
        self.known = Kept()

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if self.known[w] is None]
        root: dict = {}
        for w in new:
            node = root
            for c in self.model.symbols(w):
                node = node.setdefault(c, {})
            node.setdefault(END, []).append(w)
        self._walk(root)

    def _walk(self, root: dict) -> None:
        last, back, step = [-1], [0], self.model.last_token
        todo = list(root.items())
        while todo:
            s, node = todo.pop()
            d = len(s)
            del last[d:], back[d:]  # what is left are the states of the path above
            if END in node:
                self._finish(node.pop(END), s, last, back)
            if node:
                t, n = step(s, d, last)
                last.append(t)
                back.append(n)
                todo += [(s + c, x) for c, x in node.items()]

    def _finish(self, words: list[str], s: str, last: list[int], back: list[int]) -> None:
        t, n = self.model.last_token(s, len(s), last, self.model.suffix)
        ids, d = [t], len(s) - n
        while d:
            ids.append(last[d])
            d -= back[d]
        ids.reverse()
        made = pack(f"<{len(ids)}I", *ids)
        for w in words:
            self.known.put(w, made)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian bytes."""
        out, at, known = [], 0, self.known
        while at < len(texts):  # so many texts at once that their words fit the cache
            cut: list[list[list[str]]] = []
            words: set[str] = set()
            while at < len(texts) and len(words) < CACHE // 10:
                parts = self.model.segments(texts[at])
                cut.append([words_of(p) if i % 2 == 0 else [p] for i, p in enumerate(parts)])
                words.update(*cut[-1][::2])
                at += 1
            self.learn(words)
            for parts in cut:
                out.append(b"".join([b"".join([known[w] for w in here]) if i % 2 == 0 else pack("<I", self.model.specials[here[0]]) for i, here in enumerate(parts)]))
        return out

    def decode(self, ids: bytes) -> str:
        """The names of the tokens, joined by one space."""
        return " ".join(map(self.model.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(source: str) -> TrieCodec:
    """That of this worker process, built once."""
    return hold("bpe_codec", source, lambda: TrieCodec(Merges(source)))


def _source(tokenizer: str) -> str:
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, tokenizer: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the outputs asked for, in that order.

    outputs: n_tokens long; ids array<int>; decoded string (what decoding the ids gives back); ids_sha256 and
    decoded_sha256, lowercase hex of the ids as little-endian unsigned 32-bit integers and of the decoded string
    in UTF-8. No shuffle; the tokenizer file is broadcast. Null text counts as empty; null and repeated ids pass
    through; other columns are not read; an empty table gives no rows.
    """
    kinds = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    made = {
        "n_tokens": lambda c, i: len(i) // 4,
        "ids": lambda c, i: np.frombuffer(i, "<i4"),
        "decoded": lambda c, i: c.decode(i),
        "ids_sha256": lambda c, i: hashlib.sha256(i).hexdigest(),
        "decoded_sha256": lambda c, i: hashlib.sha256(c.decode(i).encode()).hexdigest(),
    }
    shared = docs.sparkSession.sparkContext.broadcast(_source(tokenizer))

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        c, texts, cols = codec(shared.value), b.column(1).to_pylist(), {o: [] for o in outputs}
        for a, e in chunks(texts, CHUNK // 4):
            for i in c.encode([t or "" for t in texts[a:e]]):
                for o in outputs:
                    cols[o].append(made[o](c, i))
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(cols[o], kinds[o][1]) for o in outputs]], names=["id", *outputs])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), encode, ", ".join([f"id {kind}", *[f"{o} {kinds[o][0]}" for o in outputs]])).withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): names of the tokens joined by one space, special ones included; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(_source(tokenizer))

    def decode(b: pa.RecordBatch) -> pa.RecordBatch:
        names = codec(shared.value).model.names
        got = [None if ids is None else " ".join([names[i] for i in ids if i in names]) for ids in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=["id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(id_col, ids_col), decode, f"id {kind}, decoded string").withColumnRenamed("id", id_col)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for all documents."""
    return bpe_encode(table(spark, sf_dir, "documents"), word_tokenizer(), ("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op7_bpe_codec": op7_bpe_codec}
