import pytest
from pyspark.sql import functions as F

from pergamo import fixtures as X
from pergamo import schemas
from pergamo.operators import abstracts as A
from pergamo.operators import chunks as C
from pergamo.operators import citations as Q
from pergamo.operators import lexical, search, vectors
from pergamo.operators import pages as P
from pergamo.operators import rulings as R
from pergamo.operators import sections as S
from pergamo.plans import stages
from pergamo.plans.components import components
from pergamo.sources import files


def test_late_filter_stays_above_the_cut(spark):
    ch = spark.createDataFrame([(i, str(i), "voto", 1, "alfa beta") for i in range(30)], "chunk_id long, cita string, seccion_tipo string, pagina_oficial int, texto string")
    r = ch.select("cita", F.lit("2001-01-01").alias("fecha"), F.when(F.col("chunk_id") >= 20, "x").alias("tribunal_origen"), F.lit(None).cast("string").alias("actor_tipo"), F.lit(None).cast("string").alias("demandado_tipo"))
    assert search.hybrid(ch, r, None, None, "alfa", None, 10, 10, search.Filters(court="x")).count() == 0
    assert search.hybrid(ch, r, None, None, "alfa", None, 10, 30, search.Filters(court="x")).count() == 10


def test_lexical(spark):
    rows = [(1, "La acción de amparo"), (2, "accion accion otra"), (3, "nada"), (4, "Amparo y acción, amparo")]
    ch = spark.createDataFrame(rows, "chunk_id long, texto string")
    index = lexical.build(ch)
    assert index.count() == 4
    assert {r.chunk_id for r in lexical.search_index(index, "ACCIÓN amparo").collect()} == {1, 4}
    assert lexical.search_index(index, "amparo \"*(").count() == 2 and lexical.search_index(index, "falta").count() == 0
    a = lexical.search_index(index, "accion accion").collect()
    assert a == lexical.search_scan(ch, "accion accion").collect() and [r.chunk_id for r in a][0] == 2
    changed = lexical.replace(index, spark.createDataFrame([(1, "otra cosa")], "chunk_id long, texto string"))
    assert {r.chunk_id for r in lexical.search_index(changed, "amparo").collect()} == {4} and changed.count() == 4
    with pytest.raises(ValueError):
        lexical.query_tokens(" ?! ")


def test_rrf(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "chunk_id long, rank int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "chunk_id long, rank int")
    got = {r.chunk_id: r.score for r in search.rrf({"lexico": a, "vectorial": b}).collect()}
    assert got == {1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62}
    top = search.fused_top(search.rrf({"lexico": a, "vectorial": b}), ["lexico", "vectorial"], 2).collect()
    assert [r.chunk_id for r in top] == [2, 1]


def test_grouping(spark):
    ch = spark.createDataFrame([(1, "a", "voto"), (2, "a", "voto"), (3, "b", "mayoria"), (4, "a", "mayoria"), (5, "c", None)], "chunk_id long, cita string, seccion_tipo string").withColumn("pagina_oficial", F.lit(1)).withColumn("texto", F.lit("t"))
    hits = spark.createDataFrame([(2, 0.9), (3, 0.8), (1, 0.7), (4, 0.6), (5, 0.5), (99, 1.0)], "chunk_id long, score double")
    got = search.group_by_ruling(hits, ch, 2).orderBy("orden").collect()
    assert [(r.cita, r.total_pasajes, [p.chunk_id for p in r.pasajes]) for r in got] == [("a", 3, [2, 4]), ("b", 1, [3])]


def test_requests():
    for bad in (dict(year_from=1700), dict(section="x"), dict(party="x")):
        with pytest.raises(ValueError):
            search.Filters(**bad)
    assert not search.Filters(court=" ").any
    for kw in (dict(query=" "), dict(query="x", k=0), dict(query="x", candidates=201)):
        with pytest.raises(ValueError):
            search.search_rulings(None, None, None, None, **kw)


def test_vectors(spark):
    v = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", [0.0, 1.0])], "chunk_id long, modelo string, vector array<float>")
    assert [r.chunk_id for r in vectors.search(v, [0.1, 1.0]).collect()] == [2, 1]
    with pytest.raises(ValueError):
        vectors.upsert(v, v.withColumn("vector", F.array(F.lit(1.0))), 2)
    ch = spark.createDataFrame([(1,), (3,)], "chunk_id long")
    assert [r.chunk_id for r in vectors.pending(ch, v, "m").collect()] == [3]
    with pytest.raises(ValueError):
        vectors.check_complete(ch, v)
    e = vectors.embed(spark.createDataFrame([(1, "uno dos"), (2, None)], "chunk_id long, texto string"), vectors.HashedProjection(8)).collect()
    assert sum(x * x for x in e[0].vector) == pytest.approx(1) and e[1].vector == [0.0] * 8
    with pytest.raises(ModuleNotFoundError):
        vectors.load_model("some-model").embed(["x"])


def test_segments_raise(spark):
    ends = spark.createDataFrame([(1, 10)], "tomo int, pagina_fin_cuerpo int")
    starts = lambda *s: R.ranges(spark.createDataFrame([(1, p, "c") for p in s], "tomo int, pagina_inicio int, caratula string"), ends, "indice")
    assert [(r.pagina_inicio, r.pagina_fin) for r in R.check_segments(starts(1, 4)).orderBy("pagina_inicio").collect()] == [(1, 3), (4, 10)]
    for bad in ((1, 1), (11,), ()):
        with pytest.raises(ValueError):
            R.check_segments(starts(*bad))


def test_index_of_pages(spark):
    p = spark.createDataFrame([(1, n, t) for n, t in ((1, "Nombres de las partes"), (2, "x"), (5, "ÍNDICE\nPOR LOS NÓMBRES DE LAS PARTES"), (6, "nombres de las partes"), (7, "x\ny\nnombres de las partes"))], "tomo int, pdf_page int, texto string")
    assert sorted(r.pdf_page for r in P.index_pages(p).collect()) == [5, 6]


def test_sections_cases(spark):
    cases = {
        "vacio": "", "blanco": " \n ", "solo": " solo \n",
        "todo": "TÍTULO UNO\nTexto (Disidencia del juez Luis Paz)\nDictamen de la Procuración General\nopina\nFALLO DE LA CORTE SUPREMA\nresuelve\nVoto de los jueces Ana Sol y Eva Mar\nConsiderando:\nrazones\n",
        "inline": "uno\nvoto del juez X, considerando 3)\ndos",
        "dones": "FALLO DE LA CORTE SUPREMA\nhecho\nDisidencia del señor ministro doctor don Juan de la FUENTE-SOL y del señor\nministro doctor don Raúl Ríos\nVistos los autos\nno comparto",
        "resumen": "PRIMERO DE TODOS\nuno (Voto de la jueza Mar)\nSEGUNDO TÍTULO\ndos (Voto del juez Paz)\nTERCER TÍTULO\ntres\nVoto del señor ministro don Luis Paz\nConsiderando:\na\nVoto de la jueza doña Eva Mar\nConsiderando:\nb",
        "largo": "\n".join(["Voto de los jueces Luis Paz y Eva Mar", *[f"línea {i}" for i in range(12)]]),
    }
    df = spark.createDataFrame([*cases.items(), ("nulo", None)], "cita string, texto string")
    got = {}
    for r in S.sections(df).orderBy("cita", "orden").collect():
        got.setdefault(r.cita, []).append((r.tipo, r.autor, r.orden, r.texto))
    assert "vacio" not in got and "blanco" not in got and "nulo" not in got and got["solo"] == [("mayoria", None, 0, "solo")]
    assert [x[:3] for x in got["todo"]] == [("dictamen", None, 0), ("mayoria", None, 1), ("voto", "Ana Sol, Eva Mar", 2), ("disidencia", "Luis Paz", 3)]
    assert [x[3] for x in got["todo"]] == ["opina", "resuelve", "razones", "TÍTULO UNO\nTexto (Disidencia del juez Luis Paz)"]
    assert got["inline"] == [("mayoria", None, 0, cases["inline"])]
    assert got["dones"] == [("mayoria", None, 0, "hecho"), ("disidencia", "Juan de la Fuente-Sol, Raúl Ríos", 1, "no comparto")]
    assert got["resumen"] == [
        ("mayoria", None, 0, "TERCER TÍTULO\ntres"), ("voto", "Luis Paz", 1, "SEGUNDO TÍTULO\ndos (Voto del juez Paz)\na"), ("voto", "Eva Mar", 2, "PRIMERO DE TODOS\nuno (Voto de la jueza Mar)\nb")
    ]
    assert got["largo"] == [("voto", "Luis Paz, Eva Mar " + " ".join(f"Línea {i}" for i in range(7)), 1, "\n".join(f"línea {i}" for i in range(7, 12)))]


def test_chunks_never_cross(spark):
    p = P.with_official_page(X.pages(spark))
    texts = R.ruling_texts(R.segment(P.index_entries(X.index_columns(spark)), p), p)
    sec = S.sections(texts)
    ch = C.chunk_sections(sec, texts, 12, 3)
    assert ch.count() > sec.count() and C.outside_section(ch, sec).count() == 0 and C.orphan_lines(texts, sec).count() <= 2
    assert ch.select("chunk_id").distinct().count() == ch.count()


def test_citation_context(spark):
    text = "x" * 200 + " Fallos: 1:2 " + "y" * 200
    got = Q.extract(spark.createDataFrame([("c", text)], "cita string, texto string")).first()
    assert got.contexto.startswith("...x") and got.contexto.endswith("y...") and "Fallos: 1:2" in got.contexto and len(got.contexto) <= 6 + 180 + 12
    n = spark.createDataFrame([("Fallos: 1:2; 3:4 y Fallos: 5:6",), ("nada",)], "t string").select(Q.reference_count(F.col("t"))).collect()
    assert [r[0] for r in n] == [2, 0]


def test_abstract_tables(spark):
    old = spark.createDataFrame([("a", 0, ["X", "Y"], "m"), ("b", 0, ["X"], "")], "cita string, orden int, voces array<string>, materia string")
    new = spark.createDataFrame([("a", 0, ["Z", "Z"], "n")], old.schema)
    both = A.replace_abstracts(old, new)
    assert sorted((r.cita, r.valor) for r in A.ruling_descriptors(both).collect()) == [("a", "Z"), ("b", "X")]
    assert [r.materia for r in A.branches(both).collect()] == ["n"]
    up = A.upsert_descriptors(spark.createDataFrame([("X", 1), ("Y", None)], "valor string, codigo int"), spark.createDataFrame([("X", 9), ("Y", 2), ("Z", None)], "valor string, codigo int"))
    assert {r.valor: r.codigo for r in up.collect()} == {"X": 1, "Y": 2, "Z": None}


def test_schema_rules(spark):
    bad = spark.createDataFrame([("c", "otro", 0), ("c", "voto", 0)], "cita string, tipo string, orden int")
    with pytest.raises(ValueError):
        schemas.validate(bad, "secciones")
    assert schemas.conform(bad, "secciones").columns == ["cita", "tipo", "autor", "orden", "texto"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 70: 50, 100: 50, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_resumes(spark, tmp_path, monkeypatch):
    w = stages.Workspace(spark, str(tmp_path / "ws"), vectors.HashedProjection(8))
    found = stages.register(w, X.pages(spark), P.index_entries(X.index_columns(spark)))
    monkeypatch.setattr(stages.pages, "page_quality", lambda df: df.select("tomo").distinct().withColumn("calidad", F.lit("digital")))
    good = stages.HANDLERS["fragmentar"]
    monkeypatch.setitem(stages.HANDLERS, "fragmentar", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        stages.run(w, found)
    monkeypatch.setitem(stages.HANDLERS, "fragmentar", good)
    assert stages.run(w, found) == {400: "indexado"}
    assert stages.run(w) == {400: "indexado"}
    assert w.read("chunks").count() == w.read("vectores").count() > 0
    s = stages.status(w).first()
    assert (s.etapas, s.fallos, s.avance) == (8, 2, 1.0)
    hits = search.search_rulings(w.read("chunks"), w.read("fallos"), None, w.read("vectores"), "recurso", w.model.embed_one("recurso"), 5)
    assert hits.count() >= 1 and hits.first().modo == "hibrido"


def test_states():
    assert stages.next_stage("registrado") == "descargar" and stages.next_stage("indexado") is None
    assert stages.next_stage("extraido", "requiere_ocr") is None and stages.progress("indexado") == 1.0


def test_files(spark, tmp_path):
    path = files.land_upload(b"%PDF", "x.PDF", 348, str(tmp_path))
    got = files.digests(files.binary_files(spark, str(tmp_path))).first()
    assert (got.tomo, got.length, len(got.sha256)) == (348, 4, 64) and path.endswith("348.pdf")
    with pytest.raises(ValueError):
        files.land_upload(b"", "x.txt", 1, str(tmp_path))
    tries = []

    def fetch(p):
        tries.append(p)
        if len(tries) < 3:
            raise OSError("no")
        p.write_bytes(b"x")

    assert files.download(fetch, str(tmp_path / "a.bin"), wait=0) and not files.download(fetch, str(tmp_path / "a.bin"))
    with pytest.raises(ConnectionError):
        files.download(lambda p: (_ for _ in ()).throw(OSError("no")), str(tmp_path / "b.bin"), wait=0)
    html = lambda n: f"x gina&nbsp;<span>{n}</span> de <span>2</span>"
    assert files.paged_html(spark, html, A.CATALOG_PAGER).count() == 2
    assert files.paged_records(spark, lambda *_: 3, lambda k: ["{}", "{}"] if k < 2 else [], 1, 2).count() == 3


def test_streams(spark, tmp_path):
    from pergamo.streaming import ingest

    (tmp_path / "in").mkdir()
    X.pages(spark).coalesce(1).write.json(str(tmp_path / "j"))
    part = next((tmp_path / "j").glob("*.json"))
    (tmp_path / "in" / "a.jsonl").write_text(part.read_text())
    w = stages.Workspace(spark, str(tmp_path / "ws"))
    for _ in range(2):
        q = ingest.watch_pages(spark, str(tmp_path / "in"), w, str(tmp_path / "cp"))
        q.awaitTermination()
    assert w.read("paginas").count() == 4


def test_settings(tmp_path):
    from pergamo.config import DEFAULT_MODEL, settings

    assert settings(str(tmp_path), {}) == settings(str(tmp_path), {"PERGAMO_OTHER": "x"}) and settings(str(tmp_path), {}).embedding_model == DEFAULT_MODEL
    (tmp_path / ".env").write_text("# note\nPERGAMO_DATA_DIR = 'mine'\nPERGAMO_EMBEDDING_MODEL=small\n")
    s = settings(str(tmp_path), {"PERGAMO_EMBEDDING_MODEL": "large"})
    assert (s.data_dir, s.embedding_model, s.tables) == (str(tmp_path / "mine"), "large", str(tmp_path / "mine" / "tablas"))
    assert settings(str(tmp_path), {"PERGAMO_DATA_DIR": "s3a://b/x/"}).uploads == "s3a://b/x/tomos"


def test_fused_order_on_ties(spark):
    """Equal scores: the lexical hit comes first, whatever the ids are."""
    hits = spark.createDataFrame([(1, 0.5, None, 0), (9, 0.5, 0, None)], "chunk_id long, score double, rank_lexico int, rank_vectorial int")
    ch = spark.createDataFrame([(1, "1:1", "voto", 1, "a"), (9, "1:9", "voto", 1, "b")], "chunk_id long, cita string, seccion_tipo string, pagina_oficial int, texto string")
    assert [r.cita for r in search.group_by_ruling(hits, ch, 5).orderBy("orden").collect()] == ["1:9", "1:1"]


def test_citations_are_read_where_none_are_stored(spark):
    sec = spark.createDataFrame([("1:1", 0, "ver Fallos: 2:3"), ("1:2", 0, "ver Fallos: 4:5")], "cita string, orden int, texto string")
    stored = Q.extract(sec.where("cita = '1:1'"))
    assert sorted((r.cita, r.tomo_citado) for r in search.citations_or_read(stored, sec).collect()) == [("1:1", 2), ("1:2", 4)]


def test_a_bad_volume_holds_up_no_other(spark, tmp_path, monkeypatch):
    w = stages.Workspace(spark, str(tmp_path / "ws"), vectors.HashedProjection(8))
    monkeypatch.setattr(w, "mark", lambda v, stage, state, error=None: marks.append((v, state)))
    marks = []

    def handler(w, volumes):
        if 3 in volumes:
            raise RuntimeError("lost")

    monkeypatch.setitem(stages.HANDLERS, "limpiar", handler)
    assert stages._attempt(w, "limpiar", [1, 2, 3, 4]) == [1, 2, 4] and marks == [([3], "fallido")]
    with pytest.raises(RuntimeError):
        stages._attempt(w, "limpiar", [3])
