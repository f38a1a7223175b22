"""The command line obeys the settings and works on a workspace."""

import json

from pergamo import cli, config
from pergamo.operators import vectors


def run(capsys, spark, *args):
    assert cli.main(list(args), spark) == 0
    return capsys.readouterr().out.strip().splitlines()


def test_settings_name_the_workspace_and_the_model(capsys, spark, tmp_path, monkeypatch):
    monkeypatch.delenv("PERGAMO_DATA_DIR", raising=False)
    (tmp_path / ".env").write_text('# own\nPERGAMO_DATA_DIR="deep/data"\nPERGAMO_EMBEDDING_MODEL=hashed-16\n')
    got = json.loads(run(capsys, spark, "--root", str(tmp_path), "config")[0])
    assert got == {"data_dir": f"{tmp_path}/deep/data", "embedding_model": "hashed-16", "workspace": f"{tmp_path}/deep/data/tablas"}
    monkeypatch.setenv("PERGAMO_DATA_DIR", str(tmp_path / "env"))
    assert json.loads(run(capsys, spark, "--root", str(tmp_path), "config")[0])["workspace"] == f"{tmp_path}/env/tablas"
    assert json.loads(run(capsys, spark, "--workspace", "x", "--root", str(tmp_path), "config")[0])["workspace"] == "x"
    assert isinstance(cli.model("hashed-16"), vectors.HashedProjection) and cli.model(config.DEFAULT_MODEL).name in ("hashed-64", config.DEFAULT_MODEL)


def test_versions_index_and_search(capsys, spark, tmp_path):
    """A workspace is brought to the last version, indexed, and searched by the stored index."""
    w = cli.stages.Workspace(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "1:1", "mayoria", 0, 0, 1, f"daños del estado {i}", 4, i) for i in range(3)], "tomo int, cita string, seccion_tipo string, seccion_orden int, orden int, pagina_oficial int, texto string, n_palabras int, chunk_id long")
    w.write("chunks", rows)
    w.write("fallos", spark.createDataFrame([(1, "1:1", "A c/ B", 1)], "tomo int, cita string, caratula string, pagina_inicio int"))
    at = ("--workspace", str(tmp_path))
    assert {json.loads(x)["estado"] for x in run(capsys, spark, *at, "versions")} == {"pendiente"}
    assert len(json.loads(run(capsys, spark, *at, "migrate")[0])) == 6
    assert {json.loads(x)["estado"] for x in run(capsys, spark, *at, "versions")} == {"aplicada"}
    assert json.loads(run(capsys, spark, *at, "build-index")[0]) == {"chunks": 3}
    found = [json.loads(x) for x in run(capsys, spark, *at, "search", "daños estado", "--lexical")]
    assert [(f["cita"], f["total_pasajes"], f["modo"]) for f in found] == [("1:1", 3, "solo_lexico")]
