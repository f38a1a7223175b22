import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pergamo.llm import line_dedup, simhash_dedup, substring_dedup, vector_dedup
from pergamo.llm.exact_dedup import exact_dedup


def joined(n, pairs):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def near():
    """Texts with exact copies, near copies, shared passages and a hot group."""
    rng = random.Random(5)
    vocabulary = ["w%03d" % i for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out, passage = [], text(60)
    for i in range(60):
        base = text(rng.randint(5, 120))
        out.append(base)
        if i % 3 == 0:
            words = base.split()
            words[len(words) // 2] = "CHANGED"
            out.append(" ".join(words))
        if i % 5 == 0:
            out.append(text(9) + " " + passage + "\n" + text(4))
    hot = "the hot text of many documents which is long enough to have a window of words"
    return out + [hot] * 50 + [None, "", "  ", "two words"]


def test_exact(spark, make, near):
    got = exact_dedup(make(near)).collect()
    by = {}
    for i, t in enumerate(near):
        by.setdefault(t or "", []).append(i)
    assert len(got) == len(near)
    for r in got:
        group = by[near[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))
        assert r.text_sha256 == hashlib.sha256((near[r.doc_id] or "").encode()).hexdigest()


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, make, near, monkeypatch):
    fps = [slow_fingerprint(t) for t in near]
    comp = joined(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.simhash_dedup(make(near)).collect()}
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, comp))}
    kept = [r.doc_id for r in simhash_dedup.keep_one(make(near)).collect()]
    assert sorted(kept) == sorted(set(comp))


@pytest.mark.parametrize("cell", [4096, 3])
def test_anchors_lose_no_pair(spark, cell, monkeypatch):
    """Random pairs at each distance up to two bits, and one crowded ball, whole or split into cells."""
    monkeypatch.setattr(simhash_dedup, "CELL", cell)
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [f ^ 1 << rng.randrange(64) for f in fps[:50]] + [f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in fps[50:100]] + [centre ^ 1 << b for b in range(64)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    pairs = simhash_dedup.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    place = {f: i for i, f in enumerate(signed)}
    assert joined(len(fps), [(place[r.a], place[r.b]) for r in pairs]) == joined(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])


def slow_substrings(texts, ids):
    first = {}
    words = [re.findall("[^\x20\x09-\x0D]+", t or "") for t in texts]
    for w, d in zip(words, ids):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(d, first.get(k, d))
    out = []
    for w, d in zip(words, ids):
        dead = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in dead)
        out.append((len(w), len(dead), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings(spark, make, near):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(make(near)).collect()}
    assert got == dict(enumerate(slow_substrings(near, range(len(near)))))


def test_substring_runs_and_text(spark, make):
    a = " ".join(f"a{i}" for i in range(30))
    got = {r.doc_id: r.kept_text for r in substring_dedup.substring_dedup(make([a, "x y " + a + " z", a]), keep_text=True).collect()}
    assert got == {0: a, 1: "x y z", 2: ""}


@pytest.mark.parametrize("cell", [4096, 7])
def test_vectors(spark, cell, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL", cell)
    monkeypatch.setattr(vector_dedup, "LEAF", 64)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    x = np.vstack([x, x[:60] + rng.standard_normal((60, 16)) * 0.15, np.repeat(x[:1], 30, 0), x[5:6] * 3]).astype(np.float32).astype(float)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    bad = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, [1.0], 0), (905, [float("inf")] * 16, 0), (906, [], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_dedup(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    n, found = near.sum(1), np.array([got[i][0] for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.9 * n.sum() and found.sum() > 1000
    for r in bad:
        assert got[r[0]] == (0, r[0], True)
    comp = joined(len(x), list(zip(*np.nonzero(near))))
    assert np.mean([got[i][1] == comp[i] for i in range(len(x))]) > 0.95 and all(got[i][2] == (got[i][1] == i) for i in got)


def test_vectors_of_many_lengths_and_sizes(spark):
    """Each length among its own; components whose squares overflow or vanish; null ids; columns with clashing names."""
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.1]), (6, [1e200, 0.0, 0.0]), (7, [2e200, 0.0, 0.0]), (8, [0.0, 1e-300, 0.0]), (9, [0.0, 3e-300, 1e-302]), (None, [1.0, 2.0]), (10, [5.0])]
    df = spark.createDataFrame([(i, v, "x", 1, True) for i, v in rows], "vec_id long, embedding array<double>, id string, links int, kept boolean")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_dedup(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), None: (2, 1, False), 3: (2, 3, True), 4: (2, 3, False), 5: (2, 3, False), 6: (1, 6, True), 7: (1, 6, False), 8: (1, 8, True), 9: (1, 8, False), 10: (0, 10, True)}


def test_a_vector_goes_to_about_as_many_leaves_at_every_size():
    rng = np.random.default_rng(3)
    x = vector_dedup._unit(rng.standard_normal((6000, 64)))
    shipped = [len(vector_dedup.Forest(x[:4000], n, 64, 0.95).leaves(x[4000:])[0]) / 2000 for n in (50_000, 500_000, 5_000_000, 50_000_000)]
    assert shipped[0] > 6 and max(shipped) <= 2 * shipped[0]


def test_links_of_a_crowded_leaf():
    """Counts and roots of vectors that are close all together, block by block."""
    rng = np.random.default_rng(4)
    x = vector_dedup._unit(np.vstack([rng.standard_normal(16) + rng.standard_normal((2500, 16)) * 0.02, rng.standard_normal((50, 16))]))
    n = len(x)
    links, root = vector_dedup.compare(np.arange(n), np.ones(n, np.int64), x, np.zeros(n, np.int64), (0, 0), [np.zeros(0, np.int64)] * n, 0.95)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert (links == near.sum(1)).all() and root.tolist() == joined(n, list(zip(*np.nonzero(near[:, :1]))) + [(i, i) for i in range(n)])[:2500] + root[2500:].tolist()


def slow_lines(texts):
    """All pairs of distinct lines by the similarity of their shingles."""

    order = list(dict.fromkeys(line for t in texts if t is not None for line in t.split("\n") if re.search("[^\x20\x09-\x0D]", line)))
    sets = [slow_windows(x) for x in order]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = dict(zip(order, joined(len(order), pairs)))
    seen, out = set(), []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            if line in root:
                if root[line] in seen:
                    continue
                seen.add(root[line])
            kept.append(line)
        out.append(None if t is None else "\n".join(kept))
    return out


def test_lines(spark, make):
    rng = random.Random(8)
    words = ["term%02d" % i for i in range(90)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common, texts = line(12), []
    for i in range(40):
        own = [line(rng.randint(3, 25)) for _ in range(3)]
        if i % 2:
            w = texts[-1].split("\n")[0].split()
            w[-1] = "changed"
            own.append(" ".join(w))
        texts.append("\n".join([*own, common, "", "  ", own[0]]))
    texts += [None, "", "\n", "same", "same\nSAME", common]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(make(texts)).collect()}
    want = slow_lines(texts)
    assert sum(got[i] == w for i, w in enumerate(want)) >= len(want) - 1  # bands may miss a pair
    assert all(len(got[i] or "") >= len(w or "") for i, w in enumerate(want))  # and never link what isn't similar


def slow_windows(line, k=5):
    plain = re.sub("[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")
    return {plain[i : i + k] for i in range(max(1, len(plain) - k + 1))}


def test_lines_by_character_windows(spark, make):
    """A typo within a line, lines without spaces, and characters beyond 16 bits; similarity as brute force has it."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [" ".join(word() for _ in range(12)) for _ in range(30)] + ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60)) for _ in range(10)] + ["".join(chr(rng.randrange(0x20000, 0x20400)) for _ in range(60)) for _ in range(10)]
    typo = [x[: len(x) // 2] + "é" + x[len(x) // 2 + 1 :] for x in base]
    far = [x[: len(x) // 2] + word() + word() + word() for x in base]
    for a, b, c in zip(base, typo, far):
        a, b, c = map(slow_windows, (a, b, c))
        assert len(a & b) >= 0.8 * len(a | b) and len(a & c) < 0.8 * len(a | c)
    got = {r.doc_id: r._n_dropped for r in line_dedup.line_dedup(make([*base, *typo, *far])).collect()}
    n = len(base)
    assert sum(got[i] for i in range(n, 2 * n)) >= 0.9 * n  # bands may miss a pair
    assert not any(got[i] for i in [*range(n), *range(2 * n, 3 * n)])
    row = spark.range(1).select(line_dedup.shingles(F.lit(" Ab\t\tcdeF ")).alias("a"), line_dedup.shingles(F.lit("abc")).alias("b"), line_dedup.shingles(F.lit("\U00020000" * 9)).alias("c"), line_dedup.shingles(F.lit(" ")).alias("d")).first()
    assert [len(x) for x in row] == [len(slow_windows("ab cdef")), 1, 1, 0]


def test_lines_of_a_crowded_bucket(spark, make, monkeypatch):
    """Hundreds of lines in one bucket, each like its neighbours only: one chain and one line apart, dealt to many blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    monkeypatch.setattr(line_dedup, "band_keys", lambda sig: F.array(F.lit(1).cast("long")))
    rng = random.Random(6)
    chars = [chr(0x4E00 + i) for i in range(5000)]
    rng.shuffle(chars)
    lines = ["".join(chars[6 * i : 6 * i + 100]) for i in range(400)] + ["".join(chars[4000:4100])]
    sets = [slow_windows(x) for x in lines]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert near == [(i, i - 1) for i in range(1, 400)]
    order = list(range(len(lines)))
    rng.shuffle(order)
    got = {i: r._n_dropped for r, i in ((r, order[r.doc_id]) for r in line_dedup.line_dedup(make([lines[i] for i in order])).collect())}
    first = next(i for i in order if i < 400)
    assert [i for i in got if not got[i]] in ([first, 400], [400, first])


def test_lines_meet_one_hub(spark, make, monkeypatch):
    """Edited copies of a line that several documents have: two comparisons a copy at most for all of their buckets, not one a bucket."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    words = [word() for _ in range(50)]
    copies = [" ".join(word() if i in at else w for i, w in enumerate(words)) for at in (rng.sample(range(50), 2) for _ in range(80))]
    met, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, texts: verified(met.append(pairs.count()) or pairs, texts))
    got = {r.doc_id: r._n_dropped for r in line_dedup.line_dedup(make([" ".join(words)] * 5 + copies)).collect()}
    assert [i for i in got if not got[i]] == [0]
    assert sum(met) <= 2 * len(copies)  # 142; 338 when each bucket had its smallest line as hub


def test_lines_travel_as_texts(spark):
    """What meets in joins has a line's text and sketch, not its shingles, and judges pairs as these would."""
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(400))
    lines = [long, "  " + long[:-9].upper() + "\tZ", long[:1500], "Ab\tc", "ab c", "otra"]
    docs = spark.createDataFrame([("\n".join(lines),)], "text string")
    wanted = spark.createDataFrame([(x,) for x in lines], "text string").select(F.xxhash64("text").alias("line"), "text")
    texts = line_dedup._texts(wanted.select("line"), docs)
    assert all(len(v) <= line_dedup.SKETCH for r in texts.collect() for v in r if isinstance(v, list))
    x = wanted.join(texts, "line").withColumn("h", line_dedup.shingles(F.col("text"))).collect()
    assert all(r.n == len(r.h) and r.s == r.h[: line_dedup.SKETCH] for r in x)
    side = lambda c: texts.select(F.col("line").alias(c), F.col("t").alias(f"t{c}"), F.col("n").alias(f"n{c}"))
    got = {(r.a, r.b) for r in side("a").crossJoin(side("b")).where(line_dedup._alike("a", "b")).collect()}
    assert got == {(r.line, q.line) for r in x for q in x if len({*r.h} & {*q.h}) * 5 >= 4 * len({*r.h} | {*q.h})}


def test_line_columns_and_counts(spark, make):
    docs = make(["a b c d\na b c d", "a b c d\nx"])
    got = sorted(line_dedup.line_dedup(docs).collect())
    assert [(r.doc_id, r.text, r.lang, r._n_lines, r._n_dropped) for r in got] == [(0, "a b c d", "en", 2, 1), (1, "x", "en", 2, 1)]


SHARED = [(None, "one two three four five"), (None, "six seven eight nine ten"), (None, "six seven eight nine ten"), (3, "red green blue white black"), (3, "north south east west up"), (3, "north south east west up"), (4, "one two three four five"), (5, "north south east west up")]


def test_near_copies_with_null_and_shared_ids(spark):
    """One row of each text stays, that with the smallest id, whatever other texts its id has."""
    got = simhash_dedup.keep_one(spark.createDataFrame(SHARED, "doc_id long, text string"))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(str, got.collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in ((4, SHARED[0][1]), (None, SHARED[1][1]), (3, SHARED[3][1]), (3, SHARED[4][1])))


def test_lines_with_null_and_shared_ids(spark):
    a, b, c, d, e = "alpha beta gamma", "delta epsilon zeta", "eta theta iota", "kappa lambda mu", "omikron pi rho"
    rows = [(1, a), (2, f"{a}\n{b}"), (2, f"{c}\n{d}"), (None, f"{b}\n{e}"), (None, f"{d}\n{c}\nsigma tau")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 9, r.text, r._n_dropped) for r in got.collect()) == [(1, a, 0), (2, b, 1), (2, f"{c}\n{d}", 0), (9, e, 1), (9, "sigma tau", 2)]


def test_edges(spark, edge):
    n = edge.count()
    for df in (exact_dedup(edge), simhash_dedup.simhash_dedup(edge), substring_dedup.substring_dedup(edge), line_dedup.line_dedup(edge)):
        assert df.count() == n
    none = edge.limit(0)
    for df in (exact_dedup(none), simhash_dedup.simhash_dedup(none), substring_dedup.substring_dedup(none), line_dedup.line_dedup(none), vector_dedup.vector_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert df.count() == 0
    assert {r.doc_id for r in simhash_dedup.keep_one(edge).collect()} >= {1, 4}
    assert [r.n_removed for r in substring_dedup.substring_dedup(edge).where("doc_id = 6").collect()] == [60_000]
