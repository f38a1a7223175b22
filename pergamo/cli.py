"""Command line over the library: python -m pergamo.cli COMMAND ..."""

from __future__ import annotations

import argparse
import dataclasses
import importlib.util
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from pergamo.config import DEFAULT_MODEL, settings
from pergamo.operators import abstracts, chunks, citations, lexical_store, pages, rulings, search, vectors
from pergamo.operators import sections as S
from pergamo.plans import migrations, stages
from pergamo.schemas import VERSION
from pergamo.session import local_session
from pergamo.sources import files


def show(df: DataFrame, n: int = 50) -> None:
    for row in df.limit(n).toJSON().collect():
        print(row)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pergamo", description=__doc__)
    p.add_argument("--workspace", help="folder of the tables; by default that of the settings")
    p.add_argument("--root", default=".", help="folder of the .env file")
    c = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [s := c.add_parser(name), [s.add_argument(*a, **k) for a, k in args]][0]
    pages_ = (("pages",), {"help": "JSON lines of tomo, pdf_page, texto"})
    for name in ("quality", "offset", "clean", "index", "segment", "meta", "sections", "citations", "chunks"):
        add(name, pages_)
    add("ingest", pages_, (("--force",), {"action": "store_true"}))
    add("status")
    add("embed-status", (("--model",), {"default": "hashed-64"}))
    add("parties", (("--volume",), {"type": int}))
    add("catalog", (("html",), {"nargs": "+"}))
    s = add("search", (("query",), {}), (("--k",), {"type": int, "default": 10}), (("--candidates",), {"type": int, "default": 60}), (("--lexical",), {"action": "store_true"}))
    for f in ("year-from", "year-to"):
        s.add_argument(f"--{f}", type=int)
    for f in ("court", "section", "descriptor", "branch", "party"):
        s.add_argument(f"--{f}")
    add("ruling", (("cite",), {}))
    for name in ("schema", "config", "versions", "migrate", "build-index"):
        add(name)
    return p


def model(named: str) -> vectors.EmbeddingModel:
    """The model of the settings; the hashed one where none was named and the library of the usual one is not there."""
    there = named != DEFAULT_MODEL or importlib.util.find_spec("sentence_transformers")
    return vectors.load_model(named) if there else vectors.HashedProjection()


def volume(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    p = pages.with_official_page(files.page_files(spark, path))
    none = spark.createDataFrame([], "tomo int, caratula string, paginas array<int>")
    return p, rulings.segment(none, p)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    s = settings(a.root)
    a.workspace = a.workspace or s.tables
    if a.command in ("schema", "config"):
        print(json.dumps({"version": VERSION} if a.command == "schema" else dataclasses.asdict(s) | {"workspace": a.workspace}))
        return 0
    spark = spark or local_session()
    w = stages.Workspace(spark, a.workspace, model(s.embedding_model))
    if hasattr(a, "pages"):
        p, r = volume(spark, a.pages)
        texts = lambda: rulings.ruling_texts(r, p)
    views = {
        "quality": lambda: pages.page_quality(p, True), "offset": lambda: pages.page_offset(p), "clean": lambda: pages.word_counts(p), "index": lambda: pages.index_pages(p, True),
        "segment": lambda: rulings.segment_summary(rulings.check_segments(r)), "meta": lambda: rulings.metadata_coverage(rulings.with_metadata(texts())),
        "sections": lambda: S.sections(texts()).groupBy("tipo").count(), "citations": lambda: citations.graph_summary(citations.extract(texts())),
        "chunks": lambda: chunks.chunk_summary(chunks.chunk_sections(S.sections(texts()), texts()), "cita"), "status": lambda: stages.status(w),
        "versions": lambda: migrations.workspace_states(spark, w.path).orderBy("version"),
        "embed-status": lambda: vectors.pending(w.read("chunks"), w.read("vectores"), a.model).groupBy("cita").count(),
        "parties": lambda: rulings.party_coverage(rulings.reclassify_parties(w.read("fallos"), a.volume)),
        "catalog": lambda: abstracts.catalog_entries(spark.createDataFrame([(open(f, encoding="utf-8").read(),) for f in a.html], "html string")),
    }
    if a.command in views:
        show(views[a.command]())
    elif a.command == "ingest":
        print(stages.run(w, stages.register(w, files.page_files(spark, a.pages)), a.force))
    elif a.command == "migrate":
        print(json.dumps(migrations.migrate(spark, w.path)))
    elif a.command == "build-index":
        print(json.dumps({"chunks": lexical_store.build_index(w.read("chunks"), f"{w.path}/indice").n}))
    elif a.command == "search":
        cite = search.route(a.query, spark)
        if cite:
            return main(["--workspace", a.workspace, "--root", a.root, "ruling", cite], spark)
        f = search.Filters(a.year_from, a.year_to, a.court, a.section, a.descriptor, a.branch, a.party)
        v = None if a.lexical else w.model.embed_one(a.query)
        show(search.search_rulings(w.read("chunks"), w.read("fallos"), w.read("sumarios") if w.exists("sumarios") else None, w.read("vectores"), a.query, v, a.k, a.candidates, f, lexical_store.open_index(spark, f"{w.path}/indice") if w.exists("indice") else None))
    else:
        cited = w.read("citas")
        show(search.ruling_detail(a.cite, w.read("fallos").drop("paginas", "texto"), w.read("secciones"), cited, citations.incoming(cited, w.read("fallos")), w.read("sumarios")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
