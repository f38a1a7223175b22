"""Every query that has SQL gives its rows: the same comparison that the driver makes, on the smallest tables."""

import datetime
import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from pergamo.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if v is not None and v.__class__.__name__ == "Decimal":
        return round(float(v), 5)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == names
    rows = lambda rs, cols: sorted((tuple(plain(r[cols.index(n)]) for n in names) for r in rs), key=str)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    assert got == rows(want.fetchall(), list(want.columns))
    assert got


def test_rare_terms_and_all_orders(spark, duck):
    """The whole vocabulary is returned, and orders of every remainder reach the filter."""
    terms = {r.term: r.tf for r in QUERIES["postings_all"](spark, SMALL).collect()}
    assert min(terms.values()) == 1 and sum(terms.values()) == duck.sql(r"SELECT sum(len(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'))) FROM documents").fetchall()[0][0]
    assert {r.chunk_id % 3 for r in QUERIES["filter_chunks_all"](spark, SMALL).collect()} == {0, 1, 2}


def slow_clean(text):
    if text is None:
        return None
    unit = r"(?:\d{1,4}[ \t]+)?FALLOS DE LA CORTE SUPREMA[ \t]*|DE JUSTICIA DE LA NACI[ÓO]N(?:[ \t]+\d{1,4})?[ \t]*|[ \t]*\d{1,4}[ \t]*"
    for _ in range(4):
        text = re.sub(rf"(?i)\A(?:{unit})(?:\r?\n|\Z)", "", text)
    text = re.sub(r"([^\W\d_])[ \t]*-[ \t]*\n[ \t]*([a-záéíóúñüïö])", r"\1\2", text)
    mixed = lambda w: any(map(str.isupper, w)) and any(map(str.islower, w)) and not (w[0].isupper() and w[1:].islower())
    return re.sub(r"[^\W\d_]+", lambda m: m[0][0].upper() + m[0][1:].lower() if mixed(m[0]) else m[0], text).strip()


def slow_snippet(text, terms, window=220):
    if text is None:
        return None
    plain = " ".join(text.split())
    n, hits = len(plain), [i for i in (plain.lower().find(x) for x in terms) if i >= 0]
    if n <= window:
        return plain
    back = lambda i: i - len(re.search(r"\S*\Z", plain[:i])[0])
    if not hits:
        return plain[: back(window) or window].rstrip() + "…"
    at = min(hits)
    low = max(0, at - window // 2)
    ends = [m.end() for m in re.finditer(r"[.?!]\s+(?=[A-ZÁÉÍÓÚÜÑ])", plain[low:at])]
    start = max(0, at - window // 3)
    if ends:
        start = low + ends[-1]
    elif start > 0 and plain[start - 1] != " ":
        start += len(re.match(r"\S*\s*", plain[start:])[0])
        start = back(at) if start > at else start
    end = back(min(n, max(at + 2 * window // 3, start + window)))
    end = min(n, start + window) if end <= at else end
    return ("" if ends or start == 0 else "…") + plain[start:end].strip() + ("" if end >= n else "…")


def test_all_documents_are_cleaned_and_cut(spark, tmp_path):
    """All rows and whole texts, by brute force, with nulls and a text longer than any page."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    far = "Otra frase del texto largo. " * 20_000 + "Aquí la CoNDICIÓN station- \n final. " + "y más " * 100
    more = [(10**6, None), (None, "12 FALLOS DE LA CORTE SUPREMA\nERnEsto con-\nsidera"), (10**6 + 1, far), (10**6 + 2, ""), (10**6 + 2, " \n"), (10**6 + 3, "ab " * 300)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()] + more
    cleaned = [tuple(r) for r in QUERIES["clean_documents"](spark, str(tmp_path)).collect()]
    assert sorted(cleaned, key=str) == sorted(((i, slow_clean(x)) for i, x in rows), key=str)
    cut = [tuple(r) for r in QUERIES["document_snippets"](spark, str(tmp_path)).collect()]
    assert sorted(cut, key=str) == sorted(((i, slow_snippet(x, ["tion", "ble"])) for i, x in rows), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
