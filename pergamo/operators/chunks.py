"""Chunks: overlapping word windows that never cross a section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pergamo.functions import text as T
from pergamo.plans import bitmap
from pergamo.session import settle

# Window and overlap in words, lengths of the prefixes that locate a chunk.
TARGET, OVERLAP, PREFIXES = 400, 80, (80, 40)
#: Inner words by which a beginning and the pages that hold it meet.
GRAM = 3


def locate_chunks(chunks: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """(key, pagina_oficial): the first page of a chunk's ruling that holds the chunk's beginning, 80 characters of it or else 40.

    chunks: cita, key, texto; pages: cita, pagina_oficial, texto, both collapsed. A beginning lies on few pages, and these have its
    inner words, whole and in a row: so chunk and page meet by a hash of GRAM such words, and only pages that have them are searched; a bitmap of
    the words asked for keeps all others from shuffling. The work grows with the text, not with chunks times pages. Beginnings of fewer words are searched in all pages of their ruling. Chunks that no page holds,
    and empty ones, have no row; null texts neither.
    """
    words = lambda c: F.split(c, " ")
    gram = lambda w, i: F.xxhash64(F.array_join(F.slice(w, i, GRAM), " "))
    p = pages.select("cita", "pagina_oficial", "texto").where("pagina_oficial is not null")
    of_page = F.array_distinct(T.let(words(F.col("texto")), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - GRAM + 1)), lambda i: gram(w, i))))
    index = p.select("cita", "pagina_oficial", F.explode(of_page).alias("gram"))
    begun = chunks.where("texto <> ''").select("cita", *[k for k in key if k != "cita"], F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("texto", 1, n).alias("begin")) for n in PREFIXES])).alias("b")).select("*", "b.n", "b.begin").drop("b")
    inner = words(F.col("begin"))
    begun = begun.withColumn("gram", F.when(F.size(inner) >= GRAM + 2, gram(inner, 2)))
    asked = settle(begun.where("gram is not null").select(F.xxhash64("cita", "gram").alias("lugar")).distinct())
    bits = bitmap.filter_bits(asked.count())
    index = bitmap.probe(index.withColumn("lugar", F.xxhash64("cita", "gram")), "lugar", bitmap.build(asked, "lugar", bits), bits, "_maybe").where("_maybe").drop("lugar", "_maybe")
    some = begun.where("gram is not null").join(index, ["cita", "gram"]).drop("gram")
    all_ = begun.where("gram is null").drop("gram").join(p.select("cita", "pagina_oficial"), "cita")
    met = some.unionByName(all_).join(p, ["cita", "pagina_oficial"]).where(F.instr("texto", F.col("begin")) > 0)
    best = met.groupBy(*key).agg(*[F.min(F.when(F.col("n") == n, F.col("pagina_oficial"))).alias(f"p{n}") for n in PREFIXES])
    return best.select(*key, F.coalesce(*[f"p{n}" for n in PREFIXES]).alias("pagina_oficial"))


def chunk_sections(sections: DataFrame, texts: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of all sections of all rulings; what cannot be located has the ruling's first page."""
    pages = texts.select("cita", F.explode("paginas").alias("p")).select("cita", "p.pagina_oficial", T.collapse(F.col("p.texto")).alias("texto"))
    x = sections.select("cita", F.col("tipo").alias("seccion_tipo"), F.col("autor").alias("seccion_autor"), F.col("orden").alias("seccion_orden"), F.posexplode(T.word_windows(F.col("texto"), target, overlap)).alias("orden", "palabras"))
    x = settle(x.withColumn("texto", F.array_join("palabras", " ")).withColumn("n_palabras", F.size("palabras")).drop("palabras"))
    key = ["cita", "seccion_orden", "orden"]
    x = x.join(locate_chunks(x, pages, key).withColumnRenamed("pagina_oficial", "_pagina"), key, "left").join(texts.select("cita", "pagina_inicio"), "cita")
    return x.select(F.xxhash64(*key).alias("chunk_id"), "cita", "seccion_tipo", "seccion_autor", "seccion_orden", "orden", F.coalesce("_pagina", "pagina_inicio").alias("pagina_oficial"), "texto", "n_palabras")


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, doc_id, orden, n_palabras, texto) of plain documents."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.word_windows(F.col(text_col), target, overlap)).alias("orden", "palabras"))
    return x.select(F.xxhash64("doc_id", "orden").alias("chunk_id"), "doc_id", "orden", F.size("palabras").alias("n_palabras"), F.array_join("palabras", " ").alias("texto"))


def chunk_summary(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents, chunks, mean chunks a document, median words."""
    by = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("n_palabras").alias("w"))
    per = by.agg(F.count(F.lit(1)).alias("documentos"), F.sum("n").alias("fragmentos"), F.avg("n").alias("media"))
    return per.join(F.broadcast(chunks.agg(F.median("n_palabras").alias("mediana_palabras"))))


def outside_section(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks whose words are not a stretch of their section: none, if chunking is right."""
    s = sections.select("cita", F.col("orden").alias("seccion_orden"), T.collapse(F.col("texto")).alias("seccion"))
    return chunks.join(s, ["cita", "seccion_orden"], "left").where(F.coalesce(F.instr("seccion", F.col("texto")), F.lit(0)) == 0).drop("seccion")


def orphan_lines(texts: DataFrame, sections: DataFrame) -> DataFrame:
    """Lines of rulings, as a multiset, that no section has (structural headers aside)."""
    marks = r"(?iu)^\s*(FALLO DE LA CORTE SUPREMA|Dictamen de la Procuraci[oó]n General)\s*$|^\s*(voto|disidencia)\s"
    ls = lambda df: df.select("cita", F.explode(T.lines(F.col("texto"))).alias("linea")).select("cita", T.strip(F.col("linea")).alias("linea")).where(F.col("linea") != "")
    return ls(texts).exceptAll(ls(sections)).where(~F.col("linea").rlike(marks))
