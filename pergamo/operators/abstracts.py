"""Official abstracts, their descriptors, and the catalogue of volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergamo.functions import text as T

# Formats of the remote pages and records.
CATALOG_ROW = r'(?s)lg-col-span-4[^>]*>\s*<span>\s*([^<]+?)\s*</span>.*?lg-col-span-3[^>]*>\s*<span>\s*(\d{4}(?:/\d{4})?)\s*</span>.*?href="/sj/verTomo\?tomoId=(\d+)"'
CATALOG_PAGER = r"gina&nbsp;<span>(\d+)</span> de <span>(\d+)</span>"
TOTAL_RESULTS = r'totalResultados\s*=\s*"(\d+)"'
DOCUMENT_ID = r"idDocumento=(\d+)"
ABSTRACT_JSON = "tomo string, pagina string, autos string, caratulaWeb string, fechaString string, voces string, texto string, linkDocumento string, analisisDocumental string"


def iso_from_slashes(c: Column) -> Column:
    p = r"\A(\d{1,2})/(\d{1,2})/(\d{4})"
    return F.when(c.rlike(p), F.format_string("%s-%02d-%02d", F.regexp_extract(c, p, 3), F.regexp_extract(c, p, 2).cast("int"), F.regexp_extract(c, p, 1).cast("int")))


def descriptors(c: Column) -> Column:
    """Parts between ` - `, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), " - "), T.strip), lambda x: x != "")


def branch(analysis: Column) -> Column:
    """materiaSecretaria, a string or an object with descripcion or valor."""
    raw = F.get_json_object(analysis, "$.materiaSecretaria")
    inner = F.coalesce(*[F.nullif(F.get_json_object(analysis, f"$.materiaSecretaria.{k}"), F.lit("")) for k in ("descripcion", "valor")])
    return T.blank_to_null(T.strip(F.coalesce(inner, F.when(~raw.startswith("{"), raw))))


def parse_abstracts(raw: DataFrame) -> DataFrame:
    """Records from (json, tomo, pagina): the volume and page asked for stand in where the record lacks them."""
    r = raw.select("tomo", "pagina", F.from_json("json", ABSTRACT_JSON).alias("r"))
    number = lambda c: F.nullif(F.col(f"r.{c}").try_cast("int"), F.lit(0))
    filled = lambda c: F.nullif(F.col(f"r.{c}"), F.lit(""))
    return r.select(
        F.coalesce(number("tomo"), "tomo").alias("tomo"), F.coalesce(number("pagina"), "pagina").alias("pagina"), F.coalesce(filled("autos"), filled("caratulaWeb")).alias("caratula"),
        iso_from_slashes(F.col("r.fechaString")).alias("fecha"), descriptors(F.col("r.voces")).alias("voces"), T.html_to_text(F.col("r.texto")).alias("texto"),
        F.nullif(F.regexp_extract("r.linkDocumento", DOCUMENT_ID, 1), F.lit("")).alias("id_documento"), branch(F.col("r.analisisDocumental")).alias("materia"),
    )


def total_results(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, TOTAL_RESULTS, 1), F.lit("")).cast("int")


def catalog_entries(pages: DataFrame) -> DataFrame:
    """(numero, volumen, anio, anio_desde, anio_hasta, csjn_tomo_id) from catalogue pages (html)."""
    parts = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(CATALOG_ROW), F.lit(k)).alias(n) for k, n in ((1, "label"), (2, "anio"), (3, "id"))])
    x = pages.select(F.explode(parts).alias("x"))
    label, year = F.split("x.label", "-", 2), F.split("x.anio", "/")
    return x.select(
        T.strip(F.get(label, F.lit(0))).cast("int").alias("numero"), F.nullif(T.strip(F.get(label, F.lit(1))), F.lit("")).alias("volumen"), F.col("x.anio").alias("anio"),
        F.get(year, F.lit(0)).cast("int").alias("anio_desde"), F.element_at(year, -1).cast("int").alias("anio_hasta"), F.col("x.id").alias("csjn_tomo_id"),
    )


def catalog_position(html: Column) -> Column:
    """struct<pagina, paginas> of a catalogue page; a page without a pager raises."""
    found = html.rlike(CATALOG_PAGER)
    number = lambda k: F.regexp_extract(html, CATALOG_PAGER, k).cast("int")
    return F.when(found, F.struct(number(1).alias("pagina"), number(2).alias("paginas"))).otherwise(F.raise_error(F.lit("no pager in the catalogue page")))


def catalog_summary(entries: DataFrame) -> DataFrame:
    several = entries.groupBy("numero").agg(F.count(F.lit(1)).alias("n"))
    return several.agg(F.count(F.lit(1)).alias("numeros"), F.min("numero").alias("desde"), F.max("numero").alias("hasta"), F.sum("n").alias("filas"), F.count(F.when(F.col("n") > 1, 1)).alias("varios_volumenes"))


def upsert_descriptors(old: DataFrame, new: DataFrame) -> DataFrame:
    """(valor, codigo), one row a text; a code once set stays, else the first that comes, by code."""
    both = old.select("valor", "codigo", F.lit(0).alias("age")).unionByName(new.select("valor", "codigo", F.lit(1).alias("age")))
    return both.groupBy("valor").agg(F.min_by("codigo", F.when(F.col("codigo").isNotNull(), F.struct("age", "codigo"))).alias("codigo"))


def replace_abstracts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rulings in new lose all their old abstracts; the others keep theirs."""
    return old.join(new.select("cita").distinct(), "cita", "left_anti").unionByName(new)


def ruling_descriptors(abstracts: DataFrame) -> DataFrame:
    """The bridge (cita, valor), each pair once."""
    return abstracts.select("cita", F.explode("voces").alias("valor")).distinct()


def abstracts_by_ruling(abstracts: DataFrame, cites: DataFrame) -> DataFrame:
    """(cita, sumarios) of the rulings asked for, in order."""
    some = abstracts.join(cites.select("cita").distinct(), "cita", "left_semi")
    return some.groupBy("cita").agg(F.array_sort(F.collect_list(F.struct("orden", "texto", "voces", "materia", "id_documento"))).alias("sumarios"))


def find_descriptors(descriptors_: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """Descriptors that hold the term, case aside, in order; % and _ are wildcards."""
    return descriptors_.where(F.col("valor").ilike(f"%{term.strip().upper()}%")).orderBy("valor").limit(limit)


def branches(abstracts: DataFrame) -> DataFrame:
    return abstracts.where("materia <> ''").select("materia").distinct().orderBy("materia")


def sync_summary(abstracts: DataFrame, rulings: DataFrame) -> DataFrame:
    """Per volume: rulings, with abstracts, abstracts, distinct descriptors."""
    x = rulings.where("pagina_inicio is not null and cita is not null").select("tomo", "cita").join(abstracts, "cita", "left")
    per = x.groupBy("tomo").agg(F.count_distinct("cita").alias("fallos"), F.count_distinct(F.when(F.col("orden").isNotNull(), F.col("cita"))).alias("con_sumario"), F.count("orden").alias("sumarios"))
    voices = x.select("tomo", F.explode("voces").alias("v")).groupBy("tomo").agg(F.count_distinct("v").alias("voces"))
    return per.join(voices, "tomo", "left").fillna(0, ["voces"])
