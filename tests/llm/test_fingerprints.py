"""Document fingerprints against plain sets of shingles and a slow sketch."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pergamo.llm import doc_fingerprints as D
from pergamo.session import ship_code

M = (1 << 64) - 1


def slow_mix(x):
    x = (x ^ x >> 31) * 0x9FB21C651E98DF25 & M
    x = (x ^ x >> 29) * 0xD6E8FEB86659FD93 & M
    return x ^ x >> 32


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def slow_sketch(text):
    def word(w):
        b = w.encode()
        return slow_mix((sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(b)) + len(b)) & M)

    found = set()
    for s in shingles(text):
        v = 0
        for w in s:
            v = (v * 0xD6E8FEB86659FD93 + word(w)) & M
        found.add(slow_mix(v) >> 16)
    limit = (1 << 48) // 8 - 1
    low = sorted(h for h in found if h <= limit)
    if len(low) >= 128:
        return limit, low
    return ((1 << 48) - 1, sorted(found)) if len(found) <= 128 else (sorted(found)[127], sorted(found)[:128])


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_rows(rows):
    """(id, n_chars, edited sha, fingerprint, edited fingerprint, edited, next) of (id, text) with distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        write = lambda s: "".join(f"{x:012x}" for x in (s[0], *s[1]))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), write(slow_sketch(t)), write(slow_sketch(edited)), t, edited, after)
    return out


def check(got, want):
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        n, sha, one, two, t, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha, one, two)
        small = max(len(shingles(x)) for x in (t, edited, after)) <= 128
        assert r.near_edited == pytest.approx(jaccard(t, edited), abs=1e-12 if small else 0.25)
        assert r.near_next == pytest.approx(jaccard(t, after), abs=1e-12 if small else 0.25)


def test_query_against_brute_force(spark, monkeypatch):
    """The query over the smallest table; estimates are near the true share of shingles, exact for short texts."""
    from pergamo.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    got = QUERIES["op12_doc_fingerprints"](spark, path).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    check(got, slow_rows(rows))


@pytest.mark.parametrize("chars", [2000, 10**9])
def test_order_is_cut_anywhere(spark, make, chars):
    """However many parts there are, each document meets its successor, the last one the first."""
    texts = [" ".join(f"w{(i * j) % 89}" for j in range(i % 13 * 20)) for i in range(150)]
    docs = make(texts).repartition(7)
    rows = D.in_order(docs, "doc_id", "text", chars)
    assert rows.where("ghost = 0").count() == 150 and rows.where("ghost = 1").count() == rows.select("part").distinct().count()
    check(D.edited_likeness(docs).collect(), slow_rows(list(enumerate(texts))))


def test_edges(spark, edge):
    got = D.edited_likeness(edge).collect()
    assert len(got) == edge.count()
    by_text = {}
    for d, r in zip(sorted(edge.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or "")), sorted(got, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))):
        assert r.doc_id == d.doc_id
        if d.doc_id != 4:
            by_text.setdefault(d.text or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    nothing = next(r for r in got if r.doc_id == 2)
    assert nothing.fingerprint == "f" * 12 and nothing.near_edited == 1.0 and nothing.n_chars == 0
    assert next(r for r in got if r.doc_id == 6).near_next == 1.0  # the same long text follows
    assert D.edited_likeness(edge.limit(0)).count() == 0
    alone = D.edited_likeness(edge.where("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_a_word_and_a_text_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 50)
    texts = ["a" * 500, "b c d " * 100, "x" * 49 + " " + "y" * 120 + " z", "", "one two"]
    assert [(a, b.tolist()) for a, b in D.sketches(texts)] == [(a, b) for a, b in map(slow_sketch, texts)]


def test_a_third_of_all_rows_share_an_id(spark):
    rows = [(7, f"text number {i} of the same id here") for i in range(100)] + [(100 + i, f"own text {i} with an id") for i in range(200)] + [(7, "equal rows " * 5)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = D.edited_likeness(docs).collect()
    assert len(got) == 350 and sum(r.near_next == 1.0 for r in got) == 49
    parts = D.in_order(docs, "doc_id", "text", 1000).where("ghost = 0").groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 200


def test_merging_and_containment(spark):
    """A short text's shingles in a text a hundred times as long; merged fingerprints are those of the shingles of all."""
    long = " ".join(f"word{i * 7919 % 10007}" for i in range(20_000))
    short, other = " ".join(long.split()[3000:3400]), " ".join(f"else{i}" for i in range(400))
    a, b, c = D.sketches([short, long, other])
    assert D.contained(a, b) == 1.0 and D.contained(c, b) == 0.0 and D.likeness(a, b) < 0.1
    half = D.sketches([" ".join(short.split()[:200] + other.split()[:200])])[0]
    assert D.contained(half, b) == pytest.approx(0.5, abs=0.2)
    fps = [D.write_fingerprint(x) for x in (a, b, c)]
    merged = D.merge_fingerprints(fps)
    assert merged == D.merge_fingerprints([D.merge_fingerprints(fps[1:]), fps[0]])
    assert D.read_fingerprint(merged)[0] == min(x[0] for x in (a, b, c)) and D.contained(b, D.read_fingerprint(merged)) == 1.0
    ship_code(spark)
    df = spark.createDataFrame([("k", fps[0]), ("k", fps[1]), ("k", fps[2]), ("m", fps[0]), (None, fps[2]), ("n", None)], "source string, fingerprint string")
    got = {r.source: r.fingerprint for r in D.merged_by(df, "source").collect()}
    assert got == {"k": merged, "m": fps[0], None: fps[2]}
    row = spark.createDataFrame([(fps[0], fps[1])], "a string, b string").select(D.contained_in("a", "b").alias("c"), D.likeness_of("a", "b").alias("l"), D.likeness_of("a", F.lit(None).cast("string")).alias("n")).first()
    assert (row.c, row.n) == (1.0, None) and row.l == D.likeness(a, b)
    assert D.hashes_of(df, "source").where("source = 'm'").count() == len(a[1])
