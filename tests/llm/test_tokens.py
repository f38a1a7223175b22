import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pergamo.llm.bpe_codec import bpe_decode, bpe_encode, word_tokenizer
from pergamo.llm.bpe_core import Merges
from pergamo.llm.token_counts import PrefixCounter, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "abcdef 'slltreve   \n\t\r\x85  éÉΣςİßñ漢字😀0123½.,!?-_<>|‍́\x1c"


def texts(n, seed=3):
    rng = random.Random(seed)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*out, "I'll  <|endoftext|> x<|startoftext|>Y a<|endoftext|>", "   a   b\n\n c", "a" * 300, "=" * 400, "ΑΣ ΑΣ", "", "we're  'll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(word_tokenizer())


def test_counts_at_every_prefix(library):
    counter = PrefixCounter(Merges(open(BYTES, encoding="utf-8").read()))
    for t in texts(60):
        got = counter.counts(t)
        assert len(got) == len(t) + 1
        for i in range(len(t) + 1):
            assert got[i] == len(library[0].encode(t[:i], add_special_tokens=False).ids), (t, i)


def test_token_counts(spark, make, library):
    ts = [*texts(40), None, "word " * 3000]
    got = {r.doc_id: r for r in token_counts(make(ts), BYTES, keep_prefixes=True).collect()}
    for i, t in enumerate(ts):
        t = t or ""
        n = len(library[0].encode(t, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].n_chars) == (n, len(t.encode()), len(t))
        assert got[i].prefix_tokens[-1] == n
        fit = got[i].fit_chars
        assert got[i].prefix_tokens[fit] <= 1024 and all(x > 1024 for x in got[i].prefix_tokens[fit + 1 :])


def test_encode_and_decode(spark, make, library):
    ts = [*texts(80), None]
    got = {r.doc_id: r for r in bpe_encode(make(ts), word_tokenizer(), ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()}
    for i, t in enumerate(ts):
        ids = library[1].encode(t or "", add_special_tokens=False).ids
        back = library[1].decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == back
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    encoded = bpe_encode(make(ts), word_tokenizer())
    assert {r.doc_id: r.decoded for r in bpe_decode(encoded, word_tokenizer()).collect()} == {i: r.decoded for i, r in got.items()}


def test_edges(edge):
    assert token_counts(edge, BYTES).count() == edge.count() == bpe_encode(edge, word_tokenizer()).count()
    assert token_counts(edge.limit(0), BYTES).count() == 0 == bpe_encode(edge.limit(0), word_tokenizer()).count()
