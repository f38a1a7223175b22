"""Pages of a volume: official numbers, offset, quality, cleaning, the party index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pergamo.functions import text as T
from pergamo.session import settle

# Quality thresholds and what marks and shapes the party index.
TEXT_CHARS, DIGITAL_SHARE = 200, 0.5
INDEX_MARK, INDEX_LINES = "NOMBRES DE LAS PARTES", 2
INDEX_HEADER = r"(?iu)NOMBRES|MBRES|[IÍ]NDICE|PARTES"
INDEX_HEADER_LINES = 2
#: Words whose tops differ by no more stand in one line.
LINE_GAP = 3.0
INDEX_DIVIDER = r"\A[A-ZÑ](?:\s+[A-ZÑ])*\z"
INDEX_REF = r"\bps?\.\s*(\d+(?:\s*(?:,|y)\s*\d+)*)"
INDEX_PAGES_ONLY = r"\A(?:y\s+|,\s*)?\d+(?:\s*(?:,|y)\s*\d+)*\z"


def with_official_page(pages: DataFrame) -> DataFrame:
    return pages.withColumn("pagina_oficial", T.official_page(F.col("texto")))


def with_clean_text(pages: DataFrame) -> DataFrame:
    return pages.withColumn("texto_limpio", T.clean_page(F.col("texto"), F.col("tomo") if "tomo" in pages.columns else None))


def page_offset(pages: DataFrame) -> DataFrame:
    """Per volume: the most frequent pdf_page - pagina_oficial (on a tie the one seen first) and who differs."""
    known = pages.where("pagina_oficial is not null").withColumn("d", F.col("pdf_page") - F.col("pagina_oficial"))
    best = known.groupBy("tomo", "d").agg(F.count(F.lit(1)).alias("n"), F.min("pdf_page").alias("seen"))
    best = best.groupBy("tomo").agg(F.max_by("d", F.struct("n", -F.col("seen"))).alias("offset"))
    judged = pages.join(best, "tomo", "left").withColumn("same", F.col("pdf_page") - F.col("pagina_oficial") == F.col("offset"))
    return judged.groupBy("tomo").agg(
        F.first("offset").alias("offset"),
        F.count(F.lit(1)).alias("total"),
        F.count("pagina_oficial").alias("detectadas"),
        F.count(F.when(F.col("same"), 1)).alias("consistentes"),
        F.array_sort(F.collect_list(F.when(~F.col("same"), F.col("pdf_page")))).alias("discrepancias"),
    )


#: Volumes that an error names.
NAMED = 10


def at_least_one(df: DataFrame, message: str) -> DataFrame:
    """df, written once, or ValueError: what was written is looked at, so its source is read in one pass."""
    out = settle(df)
    if out.isEmpty():
        raise ValueError(message)
    return out


def page_quality(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Per volume: pages with enough text and the verdict digital or requiere_ocr. Strict: no pages at all raise."""
    if strict:
        return at_least_one(page_quality(pages), "there are no pages to judge")
    full = F.count(F.when(F.length(T.strip(F.coalesce("texto", F.lit("")))) >= TEXT_CHARS, 1))
    out = pages.groupBy("tomo").agg(F.count(F.lit(1)).alias("paginas"), full.alias("con_texto"))
    return out.withColumn("calidad", F.when(F.col("con_texto") / F.col("paginas") >= DIGITAL_SHARE, "digital").otherwise("requiere_ocr"))


def volume_rows(pages: DataFrame) -> DataFrame:
    """(tomo, numero, calidad, paginas, offset_pagina): what is stored of each volume; a volume without a known official page has no offset."""
    counted = page_offset(pages).select("tomo", F.col("tomo").alias("numero"), F.col("total").cast("int").alias("paginas"), F.col("offset").cast("int").alias("offset_pagina"))
    return counted.join(page_quality(pages).select("tomo", "calidad"), "tomo").select("tomo", "numero", "calidad", "paginas", "offset_pagina")


def body_pages(pages: DataFrame) -> DataFrame:
    """One page an official number: the last of the PDF where a number repeats."""
    return pages.where("pagina_oficial is not null").groupBy("tomo", "pagina_oficial").agg(F.max_by("texto", "pdf_page").alias("texto"), F.max("pdf_page").alias("pdf_page"))


def word_counts(pages: DataFrame) -> DataFrame:
    """Per volume: words before and after cleaning."""
    n = lambda c: F.sum(F.size(T.words(F.col(c)))).alias
    return with_clean_text(pages).groupBy("tomo").agg(n("texto")("palabras_crudas"), n("texto_limpio")("palabras_limpias"))


def _names_index(text: Column) -> Column:
    return F.upper(T.fold(F.array_join(F.slice(T.lines(text), 1, INDEX_LINES), "\n"))).contains(INDEX_MARK)


def index_pages(pages: DataFrame, strict: bool = False) -> DataFrame:
    """The last run of consecutive pages whose first lines name the party index.

    Strict: no pages at all, or a volume without such a page, raise; one count a volume tells, from the pages marked in the same pass."""
    if strict:
        marked = settle(pages.withColumn("_marca", F.coalesce(_names_index(F.col("texto")), F.lit(False))))
        bare = marked.groupBy("tomo").agg(F.max("_marca").alias("hay"), F.count(F.lit(1)).alias("n"))
        lacking = [r.tomo for r in bare.where("not hay").orderBy("tomo").limit(NAMED).collect()]
        if lacking or marked.isEmpty():
            raise LookupError(f"no index by the names of the parties in volumes {lacking}" if lacking else "there are no pages to search for an index")
        return index_pages(marked.where("_marca").drop("_marca"))
    found = pages.where(_names_index(F.col("texto"))).withColumn("run", F.col("pdf_page") - F.row_number().over(Window.partitionBy("tomo").orderBy("pdf_page")))
    last = found.groupBy("tomo").agg(F.max("run").alias("run"))
    return found.join(last, ["tomo", "run"]).drop("run")


def index_columns(words: DataFrame, widths: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """(tomo, pdf_page, columna, lineas) from the places of words (tomo, pdf_page, x0, x1, top, palabra) and page widths (tomo, pdf_page, ancho).

    A page has two columns, left and right of the middle of its width: a word belongs to the one that has its centre. In a column a line begins where
    the next word stands more than `gap` below the one before; a line's words follow each other by x0, lines by their tops. A page without a known
    width, and words without a place, are left out. A window of one column of one page at a time.
    """
    x = words.join(widths.select("tomo", "pdf_page", "ancho"), ["tomo", "pdf_page"]).where("x0 is not null and top is not null and palabra is not null and ancho > 0")
    x = x.withColumn("columna", ((F.col("x0") + F.coalesce("x1", "x0")) / 2 >= F.col("ancho") / 2).cast("int"))
    down = Window.partitionBy("tomo", "pdf_page", "columna").orderBy("top", "x0", "palabra")
    x = x.withColumn("nueva", F.coalesce(F.col("top") - F.lag("top").over(down) > gap, F.lit(False)).cast("int")).withColumn("linea", F.sum("nueva").over(down))
    line = x.groupBy("tomo", "pdf_page", "columna", "linea").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "top", "palabra"))), lambda w: w["palabra"]), " ").alias("texto"))
    return line.groupBy("tomo", "pdf_page", "columna").agg(F.transform(F.array_sort(F.collect_list(F.struct("linea", "texto"))), lambda s: s["texto"]).alias("lineas"))


def index_entries_of(lines: Column) -> Column:
    """array<struct<caratula, paginas>> of one column of the index, folded over its lines.

    A caption gathers lines until one has page references; a line of numbers only goes on with the entry
    before; headers at the top and letters that divide the alphabet are no captions.
    """
    entry = "struct<caratula:string,paginas:array<int>>"
    start = F.struct(F.lit("").alias("text"), F.array().cast(f"array<{entry}>").alias("out"), F.lit(0).alias("seen"))
    ints = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))

    def step(s: Column, raw: Column) -> Column:
        line, seen = T.strip(raw), s["seen"] + 1
        joined = F.when(s["text"] == "", line).otherwise(F.concat_ws(" ", s["text"], line))
        refs = F.regexp_extract_all(joined, F.lit(INDEX_REF), F.lit(1))
        caption = T.strip(F.regexp_replace(T.strip(F.regexp_extract(joined, rf"(?s)\A(.*?){INDEX_REF}", 1)), r":+\z", ""))
        rest = T.strip(F.regexp_replace(joined, rf"(?s)\A.*{INDEX_REF}", ""))
        pages = F.flatten(F.transform(refs, ints))
        new = F.struct(caption.alias("caratula"), pages.alias("paginas"))
        last = F.element_at(s["out"], -1)
        longer = F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.struct(last["caratula"].alias("caratula"), F.concat(last["paginas"], ints(line)).alias("paginas"))))
        state = lambda text, out, n: F.struct(text.alias("text"), out.alias("out"), n.alias("seen"))
        return (
            F.when(line == "", s)
            .when((seen <= INDEX_HEADER_LINES) & line.rlike(INDEX_HEADER), state(s["text"], s["out"], seen))
            .when(line.rlike(INDEX_DIVIDER), state(s["text"], s["out"], seen))
            .when((s["text"] == "") & (F.size(s["out"]) > 0) & line.rlike(INDEX_PAGES_ONLY), state(s["text"], longer, seen))
            .when(F.size(refs) == 0, state(joined, s["out"], seen))
            .when(caption == "", state(rest, s["out"], seen))
            .otherwise(state(rest, F.concat(s["out"], F.array(new)), seen))
        )

    return F.aggregate(lines, start, step, lambda s: s["out"])


def index_entries(columns: DataFrame, strict: bool = False) -> DataFrame:
    """(tomo, caratula, paginas) from (tomo, pdf_page, columna, lineas); an entry never runs into the next column. Strict: no entry at all raises."""
    if strict:
        return at_least_one(index_entries(columns), "the index by the names of the parties has no entries")
    return columns.select("tomo", "pdf_page", "columna", F.posexplode(index_entries_of(F.col("lineas"))).alias("orden", "e")).select("tomo", "pdf_page", "columna", "orden", "e.caratula", "e.paginas")


def index_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("tomo").agg(F.count(F.lit(1)).alias("caratulas"), F.sum(F.size("paginas")).alias("referencias"), F.array_sort(F.flatten(F.collect_list("paginas"))).alias("paginas_citadas"))
