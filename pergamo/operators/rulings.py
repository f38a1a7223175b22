"""Rulings: segmentation of a volume, ruling texts, metadata, parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pergamo.functions import text as T
from pergamo.functions.parties import party_type
from pergamo.operators.citations import page_block
from pergamo.operators.pages import body_pages
from pergamo.session import spread

# Caption test, dates, signatures, appeals.
CAPTION_LINES, CAPTION_SMALL_CAPS = 8, 2
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
MONTH_VARIANTS = {"setiembre": 9}
COURT_DATE = r"(?iu)Buenos Aires,?\s+(\d{1,2})\s+de\s+([a-záéíóúñ]+)\s+de\s+(\d{4})"
NOTE_DATE = r"(?iu)Sentencia del\s+(\d{1,2})\s+de\s+([a-záéíóúñ]+)\s+de\s+(\d{4})"
CLOSING = r"(?iu)\b(?:Notif[ií]quese|Arch[ií]vese|c[uú]mplase|devu[eé]lv\w+|Reg[ií]strese|rem[ií]tase|H[aá]gase saber|comun[ií]quese|Publ[ií]quese|protocol[ií]cese)\b"
SIGNATURES = r"^[A-ZÁÉÍÓÚÑ][^\d\n]*—[^\d\n]*$"
SINGLE_SIGNER = r"^[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?: [A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){1,3}\.?$"
NOT_FIRST_IN_NAME = ("el", "la", "los", "las", "un", "una", "de", "del", "por", "que", "con", "y", "en", "a", "o", "al", "su", "segun", "según", "este", "esta", "no")
PROSE = ("sentencia", "corte", "voto", "recurso", "fallo", "considerando", "tribunal", "queja", "costas", "disidencia", "dictamen")
ORIGIN = r"(?iu)Tribunal de origen:\s*(.+)"
APPEAL = r"(?iu)\b(Recurso\s+(?:extraordinario|ordinario|de\s+queja|de\s+hecho|de\s+casaci[oó]n|de\s+reposici[oó]n|directo|de\s+apelaci[oó]n))\b"
FILED_BY = r"(?iu)(?:interpuest\w|deducid\w)\s+por"
COMPETENCE = r"(?iu)incidente de (?:in)?competencia|cuesti[oó]n de competencia"


def is_caption(line: Column) -> Column:
    framed = F.lower(F.concat(F.lit(" "), T.strip(line), F.lit(" ")))
    found = F.regexp_extract_all(line, F.lit(r"\p{L}+"), F.lit(0))
    return (framed.contains(" c/ ") | framed.contains(" s/ ")) & (F.size(F.filter(found, T.is_small_caps)) >= CAPTION_SMALL_CAPS)


def page_caption(text: Column) -> Column:
    """The cleaned caption among the first lines of a page that starts a ruling, else null."""
    head = F.slice(F.filter(T.lines(text), lambda x: T.strip(x) != ""), 1, CAPTION_LINES)
    return F.when(text.rlike("(?i)[cs]/"), T.clean_page(F.get(F.filter(head, is_caption), F.lit(0))))


def ranges(starts: DataFrame, ends: DataFrame, method: str) -> DataFrame:
    """Rulings from (tomo, pagina_inicio, caratula): each ends before the next, the last with the body."""
    w = Window.partitionBy("tomo").orderBy("pagina_inicio", "caratula")
    out = starts.withColumn("pagina_siguiente", F.lead("pagina_inicio").over(w)).join(F.broadcast(ends), "tomo")
    return out.select(
        "tomo", "caratula", F.concat_ws(":", "tomo", "pagina_inicio").alias("cita"), "pagina_inicio",
        F.coalesce(F.col("pagina_siguiente") - 1, "pagina_fin_cuerpo").alias("pagina_fin"), "pagina_siguiente", "pagina_fin_cuerpo",
        F.lit(method).alias("metodo"), F.lit(method != "indice").alias("dudosa"),
    )


def body_end(pages: DataFrame) -> DataFrame:
    return pages.where("pagina_oficial is not null").groupBy("tomo").agg(F.max("pagina_oficial").alias("pagina_fin_cuerpo"))


def segment(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Volumes with an index are cut by it, the others (doubtful) where a page shows a caption."""
    ends = body_end(pages)
    by_index = ranges(entries.select("tomo", F.explode("paginas").alias("pagina_inicio"), "caratula"), ends, "indice")
    rest = pages.where("pagina_oficial is not null").join(entries.select("tomo").distinct(), "tomo", "left_anti")
    one = F.explode(F.array_compact(F.array(page_caption(F.col("texto"))))).alias("caratula")  # a filter would read each caption twice
    starts = rest.select("tomo", F.col("pagina_oficial").alias("pagina_inicio"), one)
    return by_index.unionByName(ranges(starts, ends, "delimitadores"))


def check_segments(rulings: DataFrame) -> DataFrame:
    """rulings, or ValueError: no rulings, two on one page, one past the body."""
    r = rulings.groupBy("tomo", "pagina_inicio").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("pagina_inicio") > F.col("pagina_fin_cuerpo")).alias("past"))
    r = r.agg(F.count(F.lit(1)).alias("all"), F.max(F.col("n") > 1).alias("twice"), F.max("past").alias("past")).first()
    if not r["all"]:
        raise ValueError("nothing to segment")
    if r["twice"]:
        raise ValueError("two rulings start on one page")
    if r["past"]:
        raise ValueError("a ruling starts past the end of the body")
    return rulings


def segment_summary(rulings: DataFrame) -> DataFrame:
    """Per volume: rulings, first and last page, overlaps, gaps, longest and median length."""
    w = Window.partitionBy("tomo").orderBy("pagina_inicio")
    x = rulings.withColumn("sig", F.lead("pagina_inicio").over(w)).withColumn("largo", F.col("pagina_fin") - F.col("pagina_inicio") + 1)
    return x.groupBy("tomo").agg(
        F.count(F.lit(1)).alias("fallos"), F.min("pagina_inicio").alias("desde"), F.max("pagina_fin").alias("hasta"),
        F.count(F.when(F.col("pagina_fin") >= F.col("sig"), 1)).alias("solapes"), F.count(F.when(F.col("sig") - F.col("pagina_fin") > 1, 1)).alias("huecos"),
        F.max("largo").alias("mayor"), F.median("largo").alias("mediana"),
    )


def _shared_page(text: Column) -> Column:
    """What a page keeps for the ruling that ends on it: all before the next caption, and the note on its date."""

    def keep(ls: Column) -> Column:
        captions = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ls) - 1)), lambda i: F.coalesce(is_caption(F.get(ls, i)), F.lit(False)))
        return T.let(F.coalesce(F.get(captions, F.lit(0)), F.size(ls)), lambda cut: F.array_join(F.concat(F.slice(ls, F.lit(1), cut), note(ls, cut)), "\n"))

    def note(ls: Column, cut: Column) -> Column:
        return F.slice(F.filter(F.slice(ls, cut + 1, F.greatest(F.size(ls) - cut, F.lit(0))), lambda x: x.rlike(NOTE_DATE)), 1, 1)

    return T.let(T.lines(text), keep)


def ruling_pages(rulings: DataFrame, pages: DataFrame) -> DataFrame:
    """(cita, pagina_oficial, texto): clean pages of each ruling; the page where the next starts belongs to both.

    A range join by blocks of pages: an equality on volume and block, with the test within a block left over. What meets is
    dealt by ruling before it is cleaned.
    """
    r = rulings.select("cita", F.col("tomo").alias("r_tomo"), "pagina_inicio", "pagina_siguiente", F.coalesce("pagina_siguiente", "pagina_fin_cuerpo").alias("hasta"))
    r = r.where("hasta >= pagina_inicio").withColumn("r_bloque", F.explode(F.sequence(page_block(F.col("pagina_inicio")), page_block(F.col("hasta")))))
    p = body_pages(pages).withColumn("bloque", page_block(F.col("pagina_oficial")))
    x = r.join(p, (p.tomo == r.r_tomo) & (p.bloque == r.r_bloque) & p.pagina_oficial.between(r.pagina_inicio, r.hasta))
    x = spread(x.select("cita", "tomo", "pagina_oficial", (F.col("pagina_oficial") == F.col("pagina_siguiente")).alias("_comun"), "texto"), "cita")
    raw = F.when(F.col("_comun"), _shared_page(F.col("texto"))).otherwise(F.col("texto"))
    return x.select("cita", "pagina_oficial", T.clean_page(raw, F.col("tomo")).alias("texto"))


def ruling_texts(rulings: DataFrame, pages: DataFrame) -> DataFrame:
    """rulings with paginas array<struct<pagina_oficial, texto>> in order and the whole texto."""
    got = ruling_pages(rulings, pages).groupBy("cita").agg(F.array_sort(F.collect_list(F.struct("pagina_oficial", "texto"))).alias("paginas"))
    return rulings.join(got, "cita").withColumn("texto", F.array_join(F.transform("paginas", lambda p: p["texto"]), "\n"))


def _iso_date(found: Column, pattern: str) -> Column:
    names = dict(zip(MONTHS, range(1, 13))) | MONTH_VARIANTS
    months = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    m = F.try_element_at(months, F.lower(F.regexp_extract(found, pattern, 2)))
    day, year = (F.regexp_extract(found, pattern, k).cast("int") for k in (1, 3))
    return F.when(m.isNotNull(), F.format_string("%04d-%02d-%02d", year, m, day))


def ruling_date(text: Column) -> Column:
    """ISO date of the last court line, else of the last note; null for an unknown month. The day is not validated."""
    court, note = (F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.lit(-1)) for p in (COURT_DATE, NOTE_DATE))
    return F.when(court.isNotNull(), _iso_date(court, COURT_DATE)).when(note.isNotNull(), _iso_date(note, NOTE_DATE))


def _signers(block: Column) -> Column:
    """Names between em dashes: two to five words, none that only prose has."""
    plain = F.substring_index(F.regexp_replace(block, r"\([^)]*\)", ""), ".", 1)
    parts = F.transform(F.split(plain, "—"), lambda p: F.regexp_extract_all(p, F.lit(r"\p{L}+"), F.lit(0)))
    low = lambda p: F.transform(p, F.lower)
    names = F.filter(parts, lambda p: F.size(p).between(2, 5) & ~F.array_contains(T.lit_array(NOT_FIRST_IN_NAME), F.get(low(p), F.lit(0))) & ~F.arrays_overlap(low(p), T.lit_array(PROSE)))
    return F.transform(names, lambda p: T.capitalize_name(F.array_join(p, " ")))


def judges(text: Column) -> Column:
    """Signers: the first line of names with two of them (it may go on for two lines), else one name after a closing formula."""
    return F.coalesce(T.let(F.transform(T.lines(text), T.strip), _signed), F.array().cast("array<string>"))


def _signed(ls: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(ls) - 1)
    line = lambda i: F.coalesce(F.get(ls, i), F.lit(""))

    def block(i: Column) -> Column:
        one, two = line(i + 1), line(i + 2)
        more = F.when(one == "", F.lit("")).when(one.endswith(".") | (two == ""), F.concat(F.lit(" "), one)).otherwise(F.concat(F.lit(" "), one, F.lit(" "), two))
        return F.concat(line(i), more)

    signed = F.transform(F.filter(at, lambda i: line(i).rlike(SIGNATURES)), lambda i: _signers(block(i)))
    several = F.get(F.filter(signed, lambda s: F.size(s) >= 2), F.lit(0))
    after = F.flatten(F.transform(F.filter(at, lambda i: line(i).rlike(CLOSING)), lambda i: F.transform(F.filter(F.array(i + 1, i + 2, i + 3), lambda k: line(k).rlike(SINGLE_SIGNER)), lambda k: _signers(line(k)))))
    return F.coalesce(several, F.get(F.filter(after, lambda s: F.size(s) > 0), F.lit(0)))


def origin_court(text: Column) -> Column:
    """What follows `Tribunal de origen:`, with the next line unless it ends there, up to the first full stop."""
    return T.let(T.lines(text), _origin)


def _origin(ls: Column) -> Column:
    i = F.get(F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.get(ls, i).rlike(ORIGIN)), F.lit(0))
    value = T.strip(F.regexp_extract(F.get(ls, i), ORIGIN, 1))
    more = F.when(~value.endswith("."), F.concat(F.lit(" "), T.strip(F.get(ls, i + 1))))
    return F.nullif(T.strip(F.substring_index(F.concat(value, F.coalesce(more, F.lit(""))), ".", 1)), F.lit(""))


def appeal_type(text: Column, caption: Column) -> Column:
    name = lambda c: F.nullif(F.lower(T.collapse(F.regexp_extract(c, APPEAL, 1))), F.lit(""))
    filed = F.get(F.filter(T.lines(text), lambda x: x.rlike(FILED_BY) & x.rlike(APPEAL)), F.lit(0))
    return F.coalesce(name(filed), name(text), F.when(caption.rlike(COMPETENCE), "competencia"))


def parties(caption: Column) -> tuple[Column, Column]:
    """(plaintiff, defendant): around the first c/, up to the first s/ after it."""
    sides = F.split(caption, r"(?i)\s+c/\s+", 2)
    two = F.size(sides) == 2
    before_s = lambda c: F.get(F.split(c, r"(?i)\s+s/\s+", 2), F.lit(0))
    actor = F.when(two, F.get(sides, F.lit(0))).otherwise(before_s(caption))
    return T.blank_to_null(T.strip(actor)), F.when(two, T.blank_to_null(T.strip(before_s(F.get(sides, F.lit(1))))))


def with_metadata(texts: DataFrame) -> DataFrame:
    """Adds fecha, jueces, tipo_recurso, tribunal_origen and the parties with their types."""
    t, c = F.col("texto"), F.col("caratula")
    actor, defendant = parties(c)
    out = texts.withColumns({"fecha": ruling_date(t), "jueces": judges(t), "tipo_recurso": appeal_type(t, c), "tribunal_origen": origin_court(t), "actor": actor, "demandado": defendant})
    return out.withColumns({"actor_tipo": party_type(F.col("actor")), "demandado_tipo": party_type(F.col("demandado"))})


def reclassify_parties(rulings: DataFrame, volume: int | None = None) -> DataFrame:
    """Party types anew from the stored captions, of one volume or all; an unknown volume raises."""
    if volume is not None and rulings.where(F.col("tomo") == volume).isEmpty():
        raise ValueError(f"no volume {volume}")
    actor, defendant = parties(F.col("caratula"))
    here = F.lit(True) if volume is None else F.col("tomo") == volume
    new = {"actor": actor, "demandado": defendant, "actor_tipo": party_type(actor), "demandado_tipo": party_type(defendant)}
    return rulings.withColumns({k: F.when(here, v).otherwise(F.col(k)) if k in rulings.columns else F.when(here, v) for k, v in new.items()})


def party_coverage(rulings: DataFrame) -> DataFrame:
    """(tipo, n): rulings by type of party, both sides together; null: no type."""
    return rulings.select(F.explode(F.array("actor_tipo", "demandado_tipo")).alias("tipo")).groupBy("tipo").agg(F.count(F.lit(1)).alias("n"))


def party_sides(rulings: DataFrame) -> DataFrame:
    """(lado, tipo, n, total): rulings by side and type of party, with the side's total; null: no type."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("lado"), F.col(f"{s}_tipo").alias("tipo")) for s in ("actor", "demandado")])).alias("x")
    per = rulings.select(sides).select("x.*").groupBy("lado", "tipo").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("total", F.sum("n").over(Window.partitionBy("lado")))


def metadata_coverage(rulings: DataFrame) -> DataFrame:
    has = lambda c, a: F.count(F.when(c, 1)).alias(a)
    date, signed = F.col("fecha").isNotNull(), F.size("jueces") > 0
    return rulings.groupBy("tomo").agg(F.count(F.lit(1)).alias("fallos"), has(date, "con_fecha"), has(signed, "con_jueces"), has(date & signed, "con_ambos"), F.count("tribunal_origen").alias("con_tribunal"), F.count("tipo_recurso").alias("con_recurso"), F.count("demandado").alias("con_demandado"))
