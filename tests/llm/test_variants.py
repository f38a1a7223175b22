"""Spelling variants against all edits of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from pergamo.llm import spelling_variants as S


def slow_counts(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(a, b):
    """One letter inserted, deleted or replaced, from the definition."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(n):
    found = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(found[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(found[w]), n.get(form[w]))
    return out


def rows(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def test_query_against_brute_force(spark, tmp_path):
    """Whole documents, nulls, repeats and words that edits make, through the query."""
    from pergamo.llm.queries import QUERIES

    rng = random.Random(1)
    base = ["abcdefg", "aaaaaaa", "aaaaaab", "bananañas", "Àÿ×÷éèê", "mississippi", "Wordlike"]
    texts = []
    for k in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abzé") + w[i:], w[:i] + rng.choice("abzé") + w[i + 1 :]])
            words.append(w)
        texts.append(rng.choice([" ", "-", "1", "\n"]).join(words))
    docs = [*enumerate(texts), (500, None), (501, ""), (502, "short ab Ābcdefgh 中"), (None, texts[0]), (3, texts[3]), (3, texts[4])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = slow_variants(slow_counts(docs))
    assert sum(x[0] is not None for x in want.values()) > 20
    assert rows(QUERIES["op11_spelling_variants"](spark, str(tmp_path))) == want


def test_chains_ties_and_equal_letters(spark):
    n = {"aaaaaaaa": 5, "aaaaaaa": 5, "aaaaaaaaa": 4, "chainaaa": 1, "chainaab": 10, "chainabb": 100, "chainbbb": 1000, "chainbbbb": 99_999, "lonelyword": 7, "tieword": 1, "tiewora": 10, "tieworb": 10, "tieworda": 10}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = rows(S.spelling_variants(words))
    assert got == slow_variants(n)
    assert got["chainaaa"][:2] == ("chainaab", "chainbbbb") and got["tieword"][0] == "tiewora"
    assert rows(S.spelling_variants(words.limit(0))) == {}
    assert set(rows(S.spelling_variants(words.unionByName(spark.createDataFrame([(None, 3), ("nullword", None)], "word string, n long"))))) == set(n)


@pytest.mark.parametrize("head, cut", [(32, 50_000), (4, 37)])
def test_long_words_and_any_slice(spark, monkeypatch, head, cut):
    """Words longer than a key's head meet by their hash; a word far longer than a slice has short rows."""
    monkeypatch.setattr(S, "SLICE", cut)
    rng = random.Random(3)
    long = "".join(rng.choice("abcdef") for _ in range(700))
    n = {long: 100, long[:50] + long[51:]: 3, long[:400] + "z" + long[401:]: 2, long + "a": 9, "q" * 40: 50, "q" * 41: 2, "q" * 39: 5, "q" * 20 + "r" + "q" * 20: 4}
    assert rows(S.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == slow_variants(n)
    if head == 32:
        keys = sum(len(k) for k, _, _ in S.rotations(["w" * 200_000]))
        assert keys == 400_001 and all(k.shape[1] == 40 for k, _, _ in S.rotations(["ab" * 100]))


def test_edges(spark, edge):
    got = rows(S.spelling_variants(S.counted_words(edge)))
    assert got == slow_variants(slow_counts([(r.doc_id, r.text) for r in edge.collect()]))
    assert rows(S.spelling_variants(S.counted_words(edge.limit(0)))) == {}
