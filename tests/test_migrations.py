"""Tables of the first version read and rewritten as of the last, and what breaks off in between."""

import pytest
from pyspark.sql import functions as F

from pergamo.plans import migrations as M


def first_version(spark, path):
    spark.createDataFrame([(1, 7, "DE JUSTICIA DE LA NACIÓN 5\ntexto con-\nsiderado"), (2, 8, None)], "tomo int, pdf_page int, texto_crudo string").write.partitionBy("tomo").parquet(f"{path}/paginas")
    spark.createDataFrame([(1, "Provincia de Salta c/ Aceros S.A. s/ cobro", "1:5", '["Rosa Luna", "Pedro Sol"]'), (1, "sin partes", "1:9", None), (2, None, "2:1", "roto")], "tomo int, caratula string, cita string, jueces string").write.partitionBy("tomo").parquet(f"{path}/fallos")


def versions(df):
    return {r.version: r.estado for r in df.collect()}


def test_first_version_as_the_last(spark, tmp_path):
    path = str(tmp_path)
    first_version(spark, path)
    every = [m.version for m in M.MIGRATIONS]
    lazily = M.upgraded(spark.read.parquet(f"{path}/fallos"), "fallos").orderBy("cita").collect()
    assert versions(M.workspace_states(spark, path)) == dict.fromkeys(every, "pendiente")
    assert M.migrate(spark, path) == every and M.migrate(spark, path) == []
    rulings = spark.read.parquet(f"{path}/fallos").orderBy("cita").collect()
    assert [r.asDict() for r in rulings] == [r.asDict() for r in lazily]
    assert (rulings[0].jueces, rulings[0].actor_tipo, rulings[0].demandado, rulings[0].demandado_tipo) == (["Rosa Luna", "Pedro Sol"], "estado", "Aceros S.A.", "empresa")
    assert [r.jueces for r in rulings[1:]] == [[], []]
    pages = {r.pdf_page: (r.pagina_oficial, r.texto_limpio) for r in spark.read.parquet(f"{path}/paginas").collect()}
    assert pages == {7: (5, "texto considerado"), 8: (None, None)}
    assert versions(M.workspace_states(spark, path, M.MIGRATIONS[1:])) == dict.fromkeys(every, "aplicada") | {every[0]: "huerfana"}


def test_a_failure_leaves_what_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    first_version(spark, path)
    broken = (*M.MIGRATIONS[:2], M.Migration("0003_rota", "fallos", lambda df: {"x": F.raise_error(F.lit("rota")).cast("int")}))
    with pytest.raises(Exception, match="rota"):
        M.migrate(spark, path, broken)
    assert versions(M.workspace_states(spark, path, broken)) == {m.version: "aplicada" for m in M.MIGRATIONS[:2]} | {"0003_rota": "pendiente"}
    assert spark.read.parquet(f"{path}/fallos").columns == ["caratula", "cita", "jueces", "tomo"]
    real, calls = M._rename, []

    def once(s, a, b):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("broke off")
        real(s, a, b)

    monkeypatch.setattr(M, "_rename", once)
    with pytest.raises(OSError):
        M.migrate(spark, path)
    monkeypatch.undo()
    assert M.migrate(spark, path) == [m.version for m in M.MIGRATIONS[2:]]
    assert spark.read.parquet(f"{path}/fallos").where("actor_tipo = 'estado'").count() == 1
