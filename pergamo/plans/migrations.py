"""Changes of schema as column plans: a stored table of any version is read, or rewritten, as one of the last."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pergamo.functions import text as T
from pergamo.functions.parties import party_type
from pergamo.operators.rulings import parties

APPLIED = "version string, aplicada_at timestamp"


@dataclass(frozen=True)
class Migration:
    """A change of one table. `change` gives the columns it sets, from the table's as they are; none where nothing is to do, so a change
    that ran and wasn't recorded may run again."""

    version: str
    table: str
    change: Callable[[DataFrame], dict[str, F.Column]]

    def plan(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.change(df)) if self.change(df) else df


def _missing(**columns) -> Callable[[DataFrame], dict]:
    return lambda df: {k: v() for k, v in columns.items() if k not in df.columns}


def _typed_parties(df: DataFrame) -> dict:
    actor, defendant = parties(F.col("caratula"))
    every = {"actor": actor, "actor_tipo": party_type(actor), "demandado": defendant, "demandado_tipo": party_type(defendant)}
    return {k: v for k, v in every.items() if k not in df.columns}


def _list_of(column: str) -> Callable[[DataFrame], dict]:
    """A list that was stored as a JSON text; a text that is none is an empty list, as a null is."""
    return lambda df: {column: F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))} if isinstance(df.schema[column].dataType, StringType) else {}


#: In the order in which they came; a version is never taken out or changed.
MIGRATIONS = (
    Migration("0001_paginas_limpias", "paginas", _missing(texto_limpio=lambda: T.clean_page(F.col("texto_crudo")))),
    Migration("0002_paginas_oficiales", "paginas", _missing(pagina_oficial=lambda: T.official_page(F.col("texto_crudo")))),
    Migration("0003_jueces_lista", "fallos", _list_of("jueces")),
    Migration("0004_partes", "fallos", _typed_parties),
    Migration("0005_palabras", "chunks", _missing(n_palabras=lambda: F.size(T.words(F.col("texto"))))),
    Migration("0006_voces_lista", "sumarios", _list_of("voces")),
)


def applied(spark: SparkSession, path: str) -> DataFrame:
    """(version, aplicada_at) of the workspace at path; none where it has no record."""
    return spark.read.schema(APPLIED).parquet(f"{path}/migraciones") if _exists(spark, f"{path}/migraciones") else spark.createDataFrame([], APPLIED)


def states(available: DataFrame, done: DataFrame) -> DataFrame:
    """(version, estado): aplicada, pendiente, or huerfana (recorded, but no longer there), by a full outer join of both sets."""
    a, b = available.select("version").distinct().withColumn("hay", F.lit(True)), done.select("version").distinct().withColumn("hecha", F.lit(True))
    state = F.when(F.col("hay").isNull(), "huerfana").when(F.col("hecha").isNull(), "pendiente").otherwise("aplicada")
    return a.join(b, "version", "full_outer").select("version", state.alias("estado"))


def workspace_states(spark: SparkSession, path: str, migrations: tuple[Migration, ...] = MIGRATIONS) -> DataFrame:
    return states(spark.createDataFrame([(m.version,) for m in migrations], "version string"), applied(spark, path))


def upgraded(df: DataFrame, table: str, migrations: tuple[Migration, ...] = MIGRATIONS) -> DataFrame:
    """df, a table of any version, with the columns of the last one. Only a plan: nothing is read or written."""
    for m in migrations:
        if m.table == table:
            df = m.plan(df)
    return df


def migrate(spark: SparkSession, path: str, migrations: tuple[Migration, ...] = MIGRATIONS) -> list[str]:
    """Brings the tables below path to the last version and records it; returns the versions that were pending, in order.

    A table is written beside the old one with all its pending changes, takes its place by renaming, and then its versions are recorded. A
    failure before that leaves the old table and the record as they were; the next call takes up a table whose renaming broke off. Tables that
    aren't there count as of the last version. Called again, it does nothing.
    """
    have = {r.version for r in applied(spark, path).select("version").distinct().collect()}  # a row a migration
    pending = [m for m in migrations if m.version not in have]
    for table in dict.fromkeys(m.table for m in pending):
        mine = [m for m in pending if m.table == table]
        here, new, old = f"{path}/{table}", f"{path}/{table}.nueva-{mine[-1].version}", f"{path}/{table}.antes-{mine[-1].version}"
        if not _exists(spark, here) and _exists(spark, old):
            _rename(spark, new, here)
        elif _exists(spark, here) and not _exists(spark, old):
            df = upgraded(spark.read.parquet(here), table, tuple(mine))
            writer = df.write.mode("overwrite")
            (writer.partitionBy("tomo") if "tomo" in df.columns else writer).parquet(new)
            _rename(spark, here, old)
            _rename(spark, new, here)
        rows = spark.createDataFrame([(m.version,) for m in mine], "version string").withColumn("aplicada_at", F.date_trunc("second", F.current_timestamp()))
        rows.coalesce(1).write.mode("append").parquet(f"{path}/migraciones")
    return [m.version for m in pending]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _rename(spark: SparkSession, a: str, b: str) -> None:
    fs, p = _fs(spark, a)
    if not fs.rename(p, _fs(spark, b)[1]):
        raise OSError(f"{a} could not be renamed to {b}")
