"""Citations of precedents: extraction from texts, the graph and its incoming side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergamo.functions.text import let

# Anchor, list grammar, bounds, context.
ANCHOR = r"(?i)\bFallos\s*:\s*"
PAIR = r"\d{1,3}\s*:\s*\d{1,4}"
JOIN = r"\s*(?:;|,|(?:y|e)\b)\s*(?:(?:(?:esp(?:ecialmente)?|p[aá]gs?|ps?)\.?\s*)+)?"
VOLUMES, PAGES = (1, 400), (1, 8000)
MARGIN = 90
ITEM = rf"(?iu){JOIN}(?:{PAIR}|\d{{1,4}})"
LIST = rf"(?iu)\A({PAIR})((?:{JOIN}(?:{PAIR}|\d{{1,4}}))*)"
EDGE = "struct<tomo:int,pagina:int>"
#: Pages of a block of the range joins.
BLOCK = 16


def _pair(c: Column) -> tuple[Column, Column]:
    return F.regexp_extract(c, r"(\d{1,3})\s*:\s*\d{1,4}\z", 1).cast("int"), F.regexp_extract(c, r"(\d{1,4})\z", 1).cast("int")


def _in_range(volume: Column, page: Column) -> Column:
    return volume.between(*VOLUMES) & page.between(*PAGES)


def sites(text: Column) -> Column:
    """array<struct<pares, desde, hasta>>: each anchor with a citation, its pairs and the span of the whole list.

    The text is cut at the anchors. After one, the first item must be volume:page; each further item is
    another pair, or a page of the last volume unless a semicolon stands before it. The first item that
    breaks this or the bounds ends the list.
    """
    s = F.regexp_replace(text, r"(?U)\s+", " ")
    cut = F.struct(F.split(s, ANCHOR, -1).alias("parts"), F.regexp_extract_all(s, F.lit(ANCHOR), F.lit(0)).alias("marks"))
    return let(cut, lambda c: let(_spans(c["parts"], c["marks"]), lambda ends: _read(c["parts"], c["marks"], ends)))


def _spans(parts: Column, marks: Column) -> Column:
    """Where each anchor and the text after it begin."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(marks)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<desde:int,texto:int>>").alias("out")),
        lambda a, k: F.struct(
            (a["at"] + F.length(F.get(parts, k)) + F.coalesce(F.length(F.get(marks, k)), F.lit(0))).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + F.length(F.get(parts, k))).alias("desde"), (a["at"] + F.length(F.get(parts, k)) + F.coalesce(F.length(F.get(marks, k)), F.lit(0))).alias("texto")))).alias("out"),
        ),
        lambda a: a["out"],
    )


def _read(parts: Column, marks: Column, ends: Column) -> Column:
    def read(rest: Column, span: Column) -> Column:
        head, tail = F.regexp_extract(rest, LIST, 1), F.regexp_extract(rest, LIST, 2)
        first = (F.regexp_extract(head, r"\A(\d+)", 1).cast("int"), F.regexp_extract(head, r"(\d+)\z", 1).cast("int"))
        good = F.coalesce((head != "") & _in_range(*first), F.lit(False))
        state = lambda tm, stop, size, out: F.struct(tm.alias("tm"), stop.alias("stop"), size.alias("size"), out.alias("out"))
        edge = lambda t, p: F.array(F.struct(t.alias("tomo"), p.alias("pagina")).cast(EDGE))

        def step(a: Column, item: Column) -> Column:
            is_pair = item.rlike(r"\d\s*:\s*\d{1,4}\z")
            volume, page = _pair(item)
            volume = F.when(is_pair, volume).otherwise(a["tm"])
            ok = ~a["stop"] & F.when(is_pair, _in_range(volume, page)).otherwise(~item.rlike(r"\A\s*;") & page.between(*PAGES))
            return F.when(ok, state(volume, F.lit(False), a["size"] + F.length(item), F.concat(a["out"], edge(volume, page)))).otherwise(state(a["tm"], F.lit(True), a["size"], a["out"]))

        start = state(first[0], F.lit(False), F.length(head), edge(*first))
        done = F.aggregate(F.regexp_extract_all(tail, F.lit(ITEM), F.lit(0)), start, step)
        return F.when(good, F.struct(done["out"].alias("pares"), span["desde"].alias("desde"), (span["texto"] + done["size"]).alias("hasta")))

    found = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(marks))), lambda k: let(F.get(parts, k), lambda rest: read(rest, F.get(ends, k - 1))))
    return F.filter(found, lambda x: x.isNotNull())


def context(text: Column, start: Column, end: Column) -> Column:
    """The span with MARGIN characters to each side, trimmed; dots where the text goes on."""
    s = F.regexp_replace(text, r"(?U)\s+", " ")
    a, b = F.greatest(F.lit(0), start - MARGIN), F.least(F.length(s), end + MARGIN)
    return F.concat(F.when(a > 0, "...").otherwise(""), F.trim(F.substring(s, a + 1, b - a)), F.when(b < F.length(s), "...").otherwise(""))


def extract(texts: DataFrame) -> DataFrame:
    """(cita, tomo_citado, pagina_citada, contexto) from (cita, texto): one row a precedent, repeats included."""
    site = texts.select("cita", "texto", F.posexplode(sites(F.col("texto"))).alias("sitio", "x"))
    made = site.select("cita", "sitio", context(F.col("texto"), F.col("x.desde"), F.col("x.hasta")).alias("contexto"), F.posexplode("x.pares").alias("lugar", "par"))
    return made.select("cita", "sitio", "lugar", F.col("par.tomo").alias("tomo_citado"), F.col("par.pagina").alias("pagina_citada"), "contexto")


def reference_count(text: Column) -> Column:
    return F.size(sites(text))


def page_block(page: Column) -> Column:
    return F.floor(page / BLOCK).cast("int")


def _targets(rulings: DataFrame) -> DataFrame:
    """(citado, t, pagina_inicio, hasta, bloque): the blocks of BLOCK pages that each ruling's range has a part of."""
    target = rulings.where("pagina_inicio is not null").select(F.col("cita").alias("citado"), F.col("tomo").alias("t"), "pagina_inicio", F.coalesce("pagina_fin", "pagina_inicio").alias("hasta"))
    return target.where("hasta >= pagina_inicio").withColumn("bloque", F.explode(F.sequence(page_block(F.col("pagina_inicio")), page_block(F.col("hasta")))))


def _within() -> Column:
    return (F.col("tomo_citado") == F.col("t")) & F.col("pagina_citada").between(F.col("pagina_inicio"), F.col("hasta"))


def incoming(citations: DataFrame, rulings: DataFrame) -> DataFrame:
    """Who cites whom: the cited page lies in the target's range of pages, within its volume; not itself.

    Ranges are cut to blocks of BLOCK pages, so the join is an equality on volume and block, spread over all of
    them, and the test within a block is left over. A range that ends before it begins holds nothing.
    """
    named = citations.withColumn("_bloque", page_block(F.col("pagina_citada")))
    x = named.join(_targets(rulings), (F.col("_bloque") == F.col("bloque")) & _within())
    return x.where(F.col("cita") != F.col("citado")).select("citado", F.col("cita").alias("citante"), "tomo_citado", "pagina_citada", "contexto")


def incoming_counts(citations: DataFrame, rulings: DataFrame) -> DataFrame:
    """(citado, n): how many rows `incoming` has of each cited ruling, without making them.

    Citations are counted a page first, and counts meet the ranges; a ruling's citations of itself, found by its cite, are
    taken off. So the work grows with citations plus ranges, where the pairs grow with their product.
    """
    named = citations.where("cita is not null").withColumn("_bloque", page_block(F.col("pagina_citada")))
    target = _targets(rulings).where("citado is not null")
    pages = named.groupBy("tomo_citado", "pagina_citada", "_bloque").agg(F.count(F.lit(1)).alias("n"))
    every = pages.join(target, (F.col("_bloque") == F.col("bloque")) & _within()).groupBy("citado").agg(F.sum("n").alias("n"))
    own = named.join(target, (F.col("cita") == F.col("citado")) & (F.col("_bloque") == F.col("bloque")) & _within()).groupBy("citado").agg((-F.count(F.lit(1))).alias("n"))
    return every.unionByName(own).groupBy("citado").agg(F.sum("n").alias("n")).where("n > 0")


def graph_summary(citations: DataFrame) -> DataFrame:
    return citations.agg(
        F.count_distinct("cita", "sitio").alias("referencias"), F.count(F.lit(1)).alias("aristas"), F.count_distinct("tomo_citado", "pagina_citada").alias("destinos"),
        F.count_distinct("cita").alias("citantes"), F.count_distinct("tomo_citado").alias("tomos"),
    )


def top_cited(citations: DataFrame, k: int = 5) -> DataFrame:
    return citations.groupBy("tomo_citado", "pagina_citada").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tomo_citado", "pagina_citada").limit(k)


def count_by_volume(citations: DataFrame, rulings: DataFrame) -> DataFrame:
    return citations.join(rulings.select("cita", "tomo"), "cita").groupBy("tomo").agg(F.count(F.lit(1)).alias("n"))
