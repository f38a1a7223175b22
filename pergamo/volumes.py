"""Queries of the legal operators over volumes that are made of the table of orders, all rows of it, and their SQL.

Every order is a ruling of two pages: RULINGS of them make a volume. Parties, dates, courts and citations are functions of the order, so that
SQL can say what the operators are to find.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamo.functions import text as T
from pergamo.functions.parties import party_type
from pergamo.operators import abstracts as A
from pergamo.operators import chunks as C
from pergamo.operators import citations as Q
from pergamo.operators import pages as P
from pergamo.operators import rulings as R
from pergamo.operators import sections as S
from pergamo.operators import search
from pergamo.plans import migrations
from pergamo.session import settle, shared_folder, spread
from pergamo.sources import keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RULINGS = 800
MONTHS = R.MONTHS
#: (as printed in small caps, as cleaned, type) of plaintiffs and defendants.
ACTORS = (("PÉREz, JUAn", "Pérez, Juan", "persona_fisica"), ("TRANSPORTEs del SUr S.A.", "Transportes del Sur S.A.", "empresa"), ("MUNICIPALIDAd de ROSARIo", "Municipalidad de Rosario", "estado"), ("UNIVERSIDAd NACIONAl de CUYo", "Universidad Nacional de Cuyo", "organismo"))
DEFENDANTS = (("ESTADo NACIONAl", "Estado Nacional", "estado"), ("GÓMEz, ANa", "Gómez, Ana", "persona_fisica"), ("ACEROs SUREÑOs SRL", "Aceros Sureños SRL", "empresa"))
APPEALS = ("Recurso extraordinario", "Recurso ordinario", "Recurso de queja")
CITIES = ("Mendoza", "Salta", "La Plata", "Bahía Blanca", "Paraná")


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


def _pick(values: tuple, by: str, i: int | None = None) -> str:
    """SQL, for Spark and DuckDB: the value at the place of the remainder."""
    at = len(values)
    return "CASE " + " ".join(f"WHEN {by} % {at} = {n} THEN '{v if i is None else v[i]}'" for n, v in enumerate(values)) + " END"


K = "o_orderkey"
#: Columns of a ruling, in SQL that both engines read.
RULING = {
    "tomo": f"CAST(100 + floor({K} / {RULINGS}) AS INT)", "pagina": f"CAST({K} % {RULINGS} * 2 + 1 AS INT)", "impreso": f"concat({_pick(ACTORS, K, 0)}, ' c/ ', {_pick(DEFENDANTS, K, 0)}, ' s/ expediente ', {K})",
    "caratula": f"concat({_pick(ACTORS, K, 1)}, ' c/ ', {_pick(DEFENDANTS, K, 1)}, ' s/ expediente ', {K})", "dia": "CAST(day(o_orderdate) AS INT)", "mes": _pick(MONTHS, "(month(o_orderdate) - 1)"), "anio": "CAST(year(o_orderdate) AS INT)",
    "fecha": "left(CAST(o_orderdate AS STRING), 10)", "recurso": _pick(APPEALS, K), "ciudad": _pick(CITIES, K),
    "t1": "CAST(100 + o_custkey % 20 AS INT)", "p1": "CAST(o_custkey % 1500 + 1 AS INT)", "t2": f"CAST(300 + {K} % 7 AS INT)", "p2": f"CAST({K} % 900 + 1 AS INT)", "p3": f"CAST({K} % 77 + 2 AS INT)",
}
CITED = "concat('Fallos: ', t1, ':', p1, '; ', t2, ':', p2, ' y ', p3, '.')"
OPENING = f"concat('FALLO DE LA CORTE SUPREMA', chr(10), 'Buenos Aires, ', dia, ' de ', mes, ' de ', anio, '.', chr(10), 'Considerando: que el recurso es procedente, como surge de ', {CITED})"
CLOSING = "concat('Se confirma la sentencia. Notifíquese y devuélvase.', chr(10), 'Rosa Luna — Pedro Sol (según su voto) — Ana Mar.', chr(10), recurso, ' interpuesto por la parte.', chr(10), 'Tribunal de origen: Cámara Federal de', chr(10), ciudad, '. Sala A.')"
OPINION = "concat('Que adhiero al expediente ', tomo, ', ', pagina, '.')"
VOTE = f"concat('Considerando:', chr(10), {OPINION})"
VOTE_HEADER = "Voto del señor ministro doctor don Pedro Sol"
FIRST = f"concat(caratula, chr(10), {OPENING})"
SECOND = f"concat({CLOSING}, chr(10), '{VOTE_HEADER}', chr(10), {VOTE})"
R_SQL = "r AS (SELECT o_orderkey, " + ", ".join(f"{v.replace('STRING', 'VARCHAR')} AS {k}" for k, v in RULING.items()) + " FROM orders)"
CITE = "concat(tomo, ':', pagina)"
LAST = "pagina = max(pagina) OVER (PARTITION BY tomo)"

_made: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A step that several queries share, written once an application."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _made:
        _made[key] = settle(make())
    return _made[key]


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/orders.parquet"), K).selectExpr(K, *[f"{v} AS {k}" for k, v in RULING.items()])


def printed_pages(spark: SparkSession, d: str) -> DataFrame:
    """(tomo, pdf_page, texto): pages as they are printed, with running headers, small caps and broken words; six pages stand before the first."""
    broken = OPENING.replace("Considerando", "Conside-\nrando").replace("procedente", "pro - \n cedente")
    first = f"concat('DE JUSTICIA DE LA NACIÓN ', pagina, chr(10), tomo, chr(10), impreso, chr(10), {broken})"
    second = f"concat(pagina + 1, ' FALLOS DE LA CORTE SUPREMA', chr(10), tomo, chr(10), {SECOND})"
    both = F.array(*[F.struct((F.col("pagina") + 6 + i).alias("pdf_page"), F.expr(x).alias("texto")) for i, x in enumerate((first, second))])
    return _orders(spark, d).select("tomo", F.explode(both).alias("p")).select("tomo", "p.pdf_page", "p.texto")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "pages", lambda: P.with_official_page(printed_pages(spark, d)))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """The index of parties of the volumes of even number; the others have none."""
    return _orders(spark, d).where("tomo % 2 = 0").select("tomo", "caratula", F.array("pagina").alias("paginas"))


def rulings(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "rulings", lambda: R.segment(entries(spark, d), pages(spark, d)))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "texts", lambda: R.ruling_texts(rulings(spark, d), pages(spark, d)))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "metadata", lambda: R.with_metadata(texts(spark, d)))


def sections(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "sections", lambda: S.sections(texts(spark, d)))


def cited(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "cited", lambda: Q.extract(texts(spark, d)))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "chunks", lambda: C.chunk_sections(sections(spark, d), texts(spark, d), 40, 8))


def _md5(c: str):
    return F.md5(F.col(c).cast("binary"))


@query(f"WITH {R_SQL} SELECT tomo, pagina + 6 AS pdf_page, pagina AS pagina_oficial, md5({FIRST}) AS limpio FROM r UNION ALL SELECT tomo, pagina + 7, pagina + 1, md5({SECOND}) FROM r")
def volume_pages(spark, d):
    """Official numbers and clean texts of all pages: headers, broken words and small caps are gone."""
    return P.with_clean_text(pages(spark, d)).select("tomo", "pdf_page", "pagina_oficial", _md5("texto_limpio").alias("limpio"))


@query(f"WITH {R_SQL} SELECT {CITE} AS cita, caratula, pagina AS pagina_inicio, pagina + 1 AS pagina_fin, CASE WHEN tomo % 2 = 0 THEN 'indice' ELSE 'delimitadores' END AS metodo, tomo % 2 = 1 AS dudosa FROM r")
def volume_rulings(spark, d):
    """Rulings by the index where a volume has one, else by the captions of its pages."""
    return rulings(spark, d).select("cita", "caratula", "pagina_inicio", "pagina_fin", "metodo", "dudosa")


@query(f"WITH {R_SQL} SELECT {CITE} AS cita, '/api/tomos/' || tomo || '/pdf#page=' || (pagina + 6) AS enlace FROM r")
def volume_links(spark, d):
    """A link from each ruling to its page in the PDF, by the offset that its volume's pages show."""
    rows = P.volume_rows(pages(spark, d))
    return search.page_links(rulings(spark, d), rows, "/api/tomos").select("cita", "enlace")


@query(f"WITH {R_SQL} SELECT {CITE} AS cita, CAST(CASE WHEN {LAST} THEN 2 ELSE 3 END AS INT) AS n_paginas, md5(trim({FIRST} || chr(10) || {SECOND}, chr(10))) AS resumen FROM r")
def volume_texts(spark, d):
    """Whole texts; the page on which the next ruling starts counts, and what stands before its caption."""
    return texts(spark, d).select("cita", F.size("paginas").alias("n_paginas"), F.md5(T.strip(F.col("texto")).cast("binary")).alias("resumen"))


@query(f"WITH {R_SQL} SELECT {CITE} AS cita, fecha, 'Rosa Luna|Pedro Sol|Ana Mar' AS jueces, lower(recurso) AS tipo_recurso, 'Cámara Federal de ' || ciudad AS tribunal_origen, {_pick(ACTORS, K, 1)} AS actor, {_pick(DEFENDANTS, K, 1)} AS demandado, {_pick(ACTORS, K, 2)} AS actor_tipo, {_pick(DEFENDANTS, K, 2)} AS demandado_tipo FROM r")
def volume_metadata(spark, d):
    return metadata(spark, d).select("cita", "fecha", F.array_join("jueces", "|").alias("jueces"), "tipo_recurso", "tribunal_origen", "actor", "demandado", "actor_tipo", "demandado_tipo")


MAJORITY = f"concat(caratula, chr(10), substr({OPENING}, 27), chr(10), {CLOSING})"


@query(f"WITH {R_SQL} SELECT {CITE} AS cita, 'mayoria' AS tipo, CAST(NULL AS VARCHAR) AS autor, 0 AS orden, md5({MAJORITY}) AS resumen FROM r UNION ALL SELECT {CITE}, 'voto', 'Pedro Sol', 1, md5({OPINION}) FROM r")
def volume_sections(spark, d):
    """The majority, which what stands before the first header belongs to, and a judge's own vote."""
    return sections(spark, d).select("cita", "tipo", "autor", "orden", _md5("texto").alias("resumen"))


WORDS = "regexp_split_to_array(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' ')"


@query(f"WITH {R_SQL}, w AS (SELECT {CITE} AS cita, 'mayoria' AS seccion_tipo, 0 AS seccion_orden, pagina, {WORDS.format(MAJORITY)} AS w FROM r UNION ALL SELECT {CITE}, 'voto', 1, pagina + 1, {WORDS.format(OPINION)} FROM r), k AS (SELECT *, unnest(range(CASE WHEN len(w) <= 40 THEN 1 ELSE 1 + CAST(ceil((len(w) - 40) / 32.0) AS INT) END)) AS i FROM w) SELECT cita, seccion_tipo, seccion_orden, CAST(i AS INT) AS orden, CAST(len(w[i * 32 + 1 : i * 32 + 40]) AS INT) AS n_palabras, md5(array_to_string(w[i * 32 + 1 : i * 32 + 40], ' ')) AS resumen, CASE WHEN i = 0 THEN pagina END AS comienza FROM k")
def volume_chunks(spark, d):
    """Windows of words within each section, and the page on which its first one begins."""
    return chunks(spark, d).select("cita", "seccion_tipo", "seccion_orden", "orden", "n_palabras", _md5("texto").alias("resumen"), F.when(F.col("orden") == 0, F.col("pagina_oficial")).alias("comienza"))


@query(f"WITH {R_SQL} SELECT {CITE} AS cita, CAST(x.t AS INT) AS tomo_citado, CAST(x.p AS INT) AS pagina_citada, CAST(1 AS INT) AS referencias, true AS con_contexto FROM (SELECT *, unnest([{{'t': t1, 'p': p1}}, {{'t': t2, 'p': p2}}, {{'t': t2, 'p': p3}}]) AS x FROM r)")
def volume_citations(spark, d):
    """All precedents, how many references name them, and whether their context shows the reference."""
    count = texts(spark, d).select("cita", Q.reference_count(F.col("texto")).alias("referencias"))
    shown = F.col("contexto").contains("Fallos: ") & F.col("contexto").contains(F.concat_ws(":", "tomo_citado", "pagina_citada")) | (F.col("lugar") == 2) & F.col("contexto").contains(F.concat(F.lit(" y "), F.col("pagina_citada")))
    return cited(spark, d).join(count, "cita").select("cita", "tomo_citado", "pagina_citada", "referencias", shown.alias("con_contexto"))


@query(f"WITH {R_SQL}, c AS (SELECT {CITE} AS cita, unnest([{{'t': t1, 'p': p1}}, {{'t': t2, 'p': p2}}, {{'t': t2, 'p': p3}}]) AS x FROM r) SELECT concat(r.tomo, ':', r.pagina) AS citado, c.cita AS citante, c.x.t AS tomo_citado, c.x.p AS pagina_citada FROM c JOIN r ON r.tomo = c.x.t AND c.x.p BETWEEN r.pagina AND r.pagina + 1 WHERE c.cita <> concat(r.tomo, ':', r.pagina)")
def volume_incoming(spark, d):
    """Who cites which ruling, by the range of pages."""
    return Q.incoming(cited(spark, d), rulings(spark, d)).select("citado", "citante", "tomo_citado", "pagina_citada")


@query(f"WITH {R_SQL}, c AS (SELECT {CITE} AS cita, unnest([{{'t': t1, 'p': p1}}, {{'t': t2, 'p': p2}}, {{'t': t2, 'p': p3}}]) AS x FROM r) SELECT '100:1' AS cita, CAST(2 AS INT) AS secciones, CAST(3 AS INT) AS citas, CAST(nullif((SELECT count(*) FROM c WHERE c.x.t = 100 AND c.x.p BETWEEN 1 AND 2 AND cita <> '100:1'), 0) AS INT) AS citado_por")
def volume_detail(spark, d):
    """One ruling whose citations are not stored, so they are read from its sections."""
    none = spark.createDataFrame([], "cita string, orden int, texto string, voces array<string>, materia string")
    found = search.ruling_detail("100:1", rulings(spark, d), sections(spark, d), cited(spark, d).limit(0), Q.incoming(cited(spark, d), rulings(spark, d)), none)
    return found.select("cita", *[F.nullif(F.size(c), F.lit(-1)).alias(c) for c in ("secciones", "citas", "citado_por")])


@query(f"WITH {R_SQL} SELECT tomo, {CITE} AS cita, CASE WHEN tomo = 100 THEN {_pick(ACTORS, K, 2)} ELSE 'organismo' END AS actor_tipo, CASE WHEN tomo = 100 THEN {_pick(DEFENDANTS, K, 2)} END AS demandado_tipo FROM r")
def volume_reclassified(spark, d):
    """Types of the parties of one volume anew, from its captions; those of the others stay."""
    bare = rulings(spark, d).withColumn("actor_tipo", F.lit("organismo")).withColumn("demandado_tipo", F.lit(None).cast("string"))
    return R.reclassify_parties(bare, 100).select("tomo", "cita", "actor_tipo", "demandado_tipo")


@query(f"WITH {R_SQL} SELECT {CITE} AS cita, CAST(o_orderkey % 3 AS INT) AS n_jueces, {_pick(ACTORS, K, 2)} AS actor_tipo, {_pick(DEFENDANTS, K, 1)} AS demandado FROM r")
def upgraded_rulings(spark, d):
    """All rulings from a table of the first version: judges as a JSON text, no parties."""
    judges = "CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN '[\"Rosa Luna\"]' ELSE '[\"Rosa Luna\", \"Pedro Sol\"]' END AS jueces"
    old = _orders(spark, d).selectExpr("tomo", f"{CITE} AS cita", "caratula", judges)
    return migrations.upgraded(old, "fallos").select("cita", F.size("jueces").alias("n_jueces"), "actor_tipo", "demandado")


@query("SELECT CAST(coalesce(a.v, b.v) AS VARCHAR) AS version, CASE WHEN a.v IS NULL THEN 'huerfana' WHEN b.v IS NULL THEN 'pendiente' ELSE 'aplicada' END AS estado FROM (SELECT DISTINCT p_partkey AS v FROM part WHERE p_size > 10) a FULL JOIN (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_quantity > 49) b ON a.v = b.v")
def migration_states(spark, d):
    """Sets of versions against each other: parts above a size as those that are there, parts of large orders as those recorded."""
    there = spark.read.parquet(f"{d}/part.parquet").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("version"))
    done = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 49").select(F.col("l_partkey").cast("string").alias("version"))
    return migrations.states(there, done)


@query("SELECT o_orderkey AS llave, o_custkey, count(l_linenumber) AS n, CAST(sum(l_linenumber) AS BIGINT) AS suma FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def keyed_join(spark, d):
    """Orders with their lines from two tables bucketed by the order: neither the join nor the count shuffles."""
    at = f"{shared_folder(spark)}/llaves-{len(_made)}-{uuid.uuid4().hex[:8]}"
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("llave"), "o_custkey")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("llave"), "l_linenumber")
    left, right = (keyed.write_keyed(x, f"{at}/{n}", ("llave",), 8) for n, x in (("pedidos", orders), ("lineas", lines)))
    return left.join(right, "left").groupBy("llave", "o_custkey").agg(F.count("l_linenumber").alias("n"), F.sum("l_linenumber").alias("suma"))


PARTY_FORMS = (("Provincia de ", "", "estado"), ("", " S.A.", "empresa"), ("Banco Central de ", "", "organismo"), ("Sucesión de ", "", "persona_fisica"), ("Cooperativa ", "", "empresa"), ("Municipalidad de ", "", "estado"))
SEGMENT = "c_mktsegment"


@query("SELECT c_custkey AS id, " + "CASE " + " ".join(f"WHEN c_custkey % 6 = {i} THEN '{a}' || {SEGMENT} || '{b}'" for i, (a, b, _) in enumerate(PARTY_FORMS)) + " END AS parte, " + _pick(PARTY_FORMS, "c_custkey", 2) + " AS tipo FROM customer")
def customer_parties(spark, d):
    """Every customer as a party of one of six kinds."""
    name = F.expr("CASE " + " ".join(f"WHEN c_custkey % 6 = {i} THEN concat('{a}', {SEGMENT}, '{b}')" for i, (a, b, _) in enumerate(PARTY_FORMS)) + " END")
    x = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), name.alias("parte"))
    return x.select("id", "parte", party_type(F.col("parte")).alias("tipo"))


@query("SELECT c_custkey AS id, 'pedido,' || lower(c_mktsegment) || ',urgente' AS terminos, 'El <mark>' || c_mktsegment || '</mark> de ' || c_custkey AS marcado, CAST(c_custkey % 300 + 1 AS VARCHAR) || ':' || (c_custkey % 5000 + 1) AS cita FROM customer")
def customer_queries(spark, d):
    """Terms of a question, a marked word and a cite for every customer."""
    x = spark.read.parquet(f"{d}/customer.parquet")
    q = F.concat(F.lit("El pedido de "), F.col(SEGMENT), F.lit(" y los más urgente pedido"))
    marked = T.highlight(F.concat(F.lit("El "), F.col(SEGMENT), F.lit(" de "), F.col("c_custkey")), ["automobile", "building", "furniture", "household", "machinery"])
    cite = F.concat(F.lit(" Fallos: "), (F.col("c_custkey") % 300 + 1).cast("string"), F.lit(":"), (F.col("c_custkey") % 5000 + 1).cast("string"), F.lit(" "))
    return x.select(F.col("c_custkey").alias("id"), F.array_join(T.query_terms(q), ",").alias("terminos"), marked.alias("marcado"), T.cite_query(cite).alias("cita"))


@query(f"WITH {R_SQL} SELECT tomo, pagina, caratula, fecha, upper(ciudad) || '|' || upper(recurso) AS voces, 'El tribunal de ' || ciudad || ' & otros' AS texto, CAST(o_orderkey AS VARCHAR) AS id_documento, CASE WHEN o_orderkey % 2 = 0 THEN 'CIVIL' ELSE 'PENAL' END AS materia FROM r")
def order_abstracts(spark, d):
    """Every order as a record of the remote catalogue: fields that lack, dates with slashes, HTML, a branch as text or object."""
    json = """concat('{"tomo":"', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(tomo AS STRING) END, '","autos":"', CASE WHEN o_orderkey % 5 = 0 THEN concat('","caratulaWeb":"', caratula) ELSE caratula END, '","fechaString":"', dia, '/', CAST(substr(fecha, 6, 2) AS INT), '/', anio,
        '","voces":"', upper(ciudad), ' -  - ', upper(recurso), ' ","texto":"<p>El&nbsp;tribunal <b>de</b> ', ciudad, ' &amp;&#32;otros</p>","linkDocumento":"ver.html?idDocumento=', o_orderkey, '&x=1","analisisDocumental":{"materiaSecretaria":',
        CASE WHEN o_orderkey % 2 = 0 THEN '"CIVIL"' ELSE '{"descripcion":" PENAL "}' END, '}}')"""
    return A.parse_abstracts(_orders(spark, d).selectExpr(f"{json} AS json", "tomo", "pagina")).withColumn("voces", F.array_join("voces", "|"))


@query(f"SELECT CAST(o_orderkey % 400 + 1 AS INT) AS numero, CASE WHEN o_orderkey % 3 = 0 THEN 'II' END AS volumen, CASE WHEN o_orderkey % 2 = 0 THEN '1990' ELSE '1879/1880' END AS anio, CASE WHEN o_orderkey % 2 = 0 THEN 1990 ELSE 1879 END AS anio_desde, CASE WHEN o_orderkey % 2 = 0 THEN 1990 ELSE 1880 END AS anio_hasta, CAST(o_orderkey AS VARCHAR) AS csjn_tomo_id FROM orders")
def order_catalog(spark, d):
    """Every order as a row of a page of the catalogue, twenty rows a page."""
    row = """concat('<div class="lg-col-span-4 x"><span> ', o_orderkey % 400 + 1, CASE WHEN o_orderkey % 3 = 0 THEN '-II' ELSE '' END, ' </span></div><div class="lg-col-span-3"><span>', CASE WHEN o_orderkey % 2 = 0 THEN '1990' ELSE '1879/1880' END, '</span></div><a href="/sj/verTomo?tomoId=', o_orderkey, '">v</a>')"""
    x = spark.read.parquet(f"{d}/orders.parquet").selectExpr("floor(o_orderkey / 20) AS pagina", f"{row} AS fila")
    return A.catalog_entries(x.groupBy("pagina").agg(F.array_join(F.collect_list("fila"), "\n").alias("html")))
