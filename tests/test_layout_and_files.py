"""Two-column pages from word boxes, references of HTML, files that a stream takes once."""

import html
import random

import pytest
from pyspark.sql import functions as F

from pergamo.functions import text as T
from pergamo.operators import pages as P
from pergamo.operators import search
from pergamo.plans import stages
from pergamo.streaming import ingest


def test_columns_from_word_boxes(spark):
    """Words in any order, of uneven tops; a wide word belongs where its centre is; a page without width has no columns."""
    left = [["NOMBRES", "DE", "LAS", "PARTES"], ["Pérez", "c/", "Estado:", "p.", "1"], ["Gómez", "s/", "amparo:", "ps.", "2", "y", "3"]]
    right = [["Roca:", "p.", "7"], ["8"]]
    boxes = [(1, 5, 20.0 + 20 * i + 200 * c, 38.0 + 20 * i + 200 * c, 10.0 * n + (i % 3), w) for c, col in enumerate((left, right)) for n, line in enumerate(col) for i, w in enumerate(line)]
    boxes += [(1, 5, 190.0, 260.0, 50.0, "ancha"), (1, 6, 1.0, 2.0, 1.0, "sin"), (1, 5, None, None, 1.0, "x"), (1, 7, 150.0, None, 5.0, "borde"), (1, 5, 20.0, 30.0, 99.0, None)]
    random.Random(1).shuffle(boxes)
    words = spark.createDataFrame(boxes, "tomo int, pdf_page int, x0 double, x1 double, top double, palabra string")
    widths = spark.createDataFrame([(1, 5, 400.0), (1, 7, 300.0), (1, 6, None)], "tomo int, pdf_page int, ancho double")
    got = {(r.pdf_page, r.columna): r.lineas for r in P.index_columns(words, widths).collect()}
    assert got == {(5, 0): [" ".join(x) for x in left], (5, 1): [" ".join(x) for x in right] + ["ancha"], (7, 1): ["borde"]}
    entries = P.index_entries(P.index_columns(words, widths).where("pdf_page = 5 and columna = 0"))
    assert [(r.caratula, r.paginas) for r in entries.orderBy("orden").collect()] == [("Pérez c/ Estado", [1]), ("Gómez s/ amparo", [2, 3])]
    assert P.index_columns(words.limit(0), widths).count() == 0


def test_references_as_browsers_read_them(spark):
    rng = random.Random(2)
    pieces = ["&amp;", "&amp", "&ampx;", "&lt;", "&#39;", "&#x27;", "&#X1F600;", "&#128;", "&#129;", "&#0;", "&#55296;", "&#1114112;", "&#99999999999999999999;", "&#xFFFFFFFFFFFF;", "&#1;", "&#64976;", "&#65534;", "&#13;", "&notit;", "&notin;", "&not", "&eacute;", "&eacute", "&Eacute;l", "&ordm", "&unknown;", "&", "&;", "& amp;", "&#;", "&#x;", "&CounterClockwiseContourIntegral;", "&ngE;", "&frac12", "a", " ", "&amp;lt;", "&nbsp;", "&é;", "&#233", "&#00233;x"]
    texts = pieces + ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(300)] + ["", None, "&" * 50]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", T.unescape(F.col("t")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: None if x is None else html.unescape(x) for i, x in enumerate(texts)}


def test_a_stream_takes_each_content_once(spark, tmp_path):
    """Copies, a file moved to a folder below, renamed ones, empty ones, and a restart from the checkpoint."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    (folder / "deep").mkdir(parents=True)
    one, two = '{"tomo": 1, "pdf_page": 1, "texto": "a"}\n\nbroken\n{"tomo": 1, "pdf_page": 2}\n', '{"tomo": 2, "pdf_page": 1, "texto": "ñ"}'

    def run():
        q = ingest.new_files(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return spark.read.parquet(out)

    (folder / "a.jsonl").write_text(one)
    (folder / "copy of a.jsonl").write_text(one)
    (folder / "empty.jsonl").write_text("")
    (folder / "other.txt").write_text("no")
    assert run().count() == 1
    (folder / "a.jsonl").rename(folder / "deep" / "moved.jsonl")
    (folder / "copy of a.jsonl").rename(folder / "renamed.jsonl")
    (folder / "deep" / "b.jsonl").write_text(two)
    got = run()
    assert got.count() == 2 == got.select("sha256").distinct().count()
    assert sorted((r.tomo, r.pdf_page, r.texto) for r in ingest.pages_of(got).collect()) == [(1, 1, "a"), (1, 2, None), (2, 1, "ñ")]
    (folder / "b again.jsonl").write_text(two)
    assert run().count() == 2
    assert ingest.pages_of(got.limit(0)).isEmpty()
    plan = ingest.new_files(spark, str(folder), late="1 hour")
    assert plan.isStreaming


def test_what_is_missing_raises(spark):
    """No pages, a volume without an index, an index without entries; what is there comes through as without the check."""
    pages = spark.createDataFrame([(1, 4, "NOMBRES DE LAS PARTES\nx"), (1, 5, "texto"), (2, 9, "texto"), (3, 1, None)], "tomo int, pdf_page int, texto string")
    with pytest.raises(LookupError, match=r"\[2, 3\]"):
        P.index_pages(pages, strict=True)
    one = pages.where("tomo = 1")
    assert P.index_pages(one, strict=True).collect() == P.index_pages(one).collect() != []
    assert sorted(P.page_quality(pages, strict=True).collect()) == sorted(P.page_quality(pages).collect())
    for raised, call in ((LookupError, P.index_pages), (ValueError, P.page_quality)):
        with pytest.raises(raised):
            call(pages.limit(0), strict=True)
    columns = spark.createDataFrame([(1, 4, 0, ["sin", "páginas"])], "tomo int, pdf_page int, columna int, lineas array<string>")
    with pytest.raises(ValueError):
        P.index_entries(columns, strict=True)
    assert P.index_entries(columns).count() == 0


def test_links_by_the_stored_offset(spark, tmp_path):
    """The stage that numbers pages stores each volume's offset; a volume without one links to the file."""
    w = stages.Workspace(spark, str(tmp_path))
    rows = [(7, n, f"DE JUSTICIA DE LA NACIÓN {n - 4}\ntexto") for n in range(5, 9)] + [(7, 9, "sin número"), (8, 1, "nada"), (8, 2, None)]
    stages.register(w, spark.createDataFrame(rows, "tomo int, pdf_page int, texto string"))
    stages.extract(w, [7, 8])
    got = {r.tomo: (r.numero, r.calidad, r.paginas, r.offset_pagina) for r in w.read("tomos").collect()}
    assert got == {7: (7, "requiere_ocr", 5, 4), 8: (8, "requiere_ocr", 2, None)}
    places = spark.createDataFrame([(7, 2), (7, None), (8, 1), (9, 1)], "tomo int, pagina_inicio int")
    links = [r.enlace for r in search.page_links(places, w.read("tomos"), "/api/tomos").orderBy("tomo", "pagina_inicio").collect()]
    assert links == ["/api/tomos/7/pdf", "/api/tomos/7/pdf#page=6", "/api/tomos/8/pdf", "/api/tomos/9/pdf"]
