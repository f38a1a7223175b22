"""Schemas of all tables and records, and the checks that Parquet does not make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 6

SCHEMAS = {
    "tomos": "numero int, volumen string, anio string, csjn_tomo_id string, pdf_path string, sha256 string, calidad string, paginas int, offset_pagina int, estado string, indexado_at timestamp",
    "paginas": "tomo int, pdf_page int, pagina_oficial int, texto_crudo string, texto_limpio string",
    "fallos": "tomo int, caratula string, cita string, pagina_inicio int, pagina_fin int, fecha string, tribunal_origen string, tipo_recurso string, jueces array<string>, actor string, actor_tipo string, demandado string, demandado_tipo string",
    "secciones": "cita string, tipo string, autor string, orden int, texto string",
    "chunks": "chunk_id bigint, cita string, seccion_tipo string, seccion_autor string, seccion_orden int, orden int, pagina_oficial int, texto string, n_palabras int",
    "citas": "cita string, tomo_citado int, pagina_citada int, contexto string",
    "sumarios": "cita string, orden int, texto string, voces array<string>, materia string, id_documento string",
    "voces": "valor string, codigo int",
    "fallo_voces": "cita string, valor string",
    "vectores": "chunk_id bigint, modelo string, vector array<float>",
    "etapas": "tomo int, etapa string, estado string, intentos int, error string, terminado_at timestamp",
}

# What the enumerated columns may hold.
ENUMS = {
    ("tomos", "calidad"): ("desconocida", "digital", "requiere_ocr"),
    ("tomos", "estado"): ("registrado", "descargado", "extraido", "limpio", "segmentado", "estructurado", "fragmentado", "embebido", "indexado"),
    ("secciones", "tipo"): ("dictamen", "mayoria", "voto", "disidencia"),
    ("fallos", "actor_tipo"): ("persona_fisica", "empresa", "estado", "organismo"),
    ("fallos", "demandado_tipo"): ("persona_fisica", "empresa", "estado", "organismo"),
    ("etapas", "estado"): ("pendiente", "en_proceso", "hecho", "fallido"),
}
KEYS = {"tomos": ["numero", "volumen"], "paginas": ["tomo", "pdf_page"], "fallos": ["cita"], "secciones": ["cita", "orden"], "chunks": ["cita", "seccion_orden", "orden"], "sumarios": ["cita", "orden"], "voces": ["valor"], "fallo_voces": ["cita", "valor"], "vectores": ["chunk_id"]}


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with just the table's columns and types; what is missing becomes null."""
    empty = df.sparkSession.createDataFrame([], SCHEMAS[table])
    return empty.unionByName(df.select(*[c for c in df.columns if c in empty.columns]), allowMissingColumns=True)


def violations(df: DataFrame, table: str) -> DataFrame:
    """(rule, n): how many rows break an enumeration and how many keys repeat."""
    parts = []
    for (t, c), values in ENUMS.items():
        if t == table and c in df.columns:
            parts.append(df.where(F.col(c).isNotNull() & ~F.col(c).isin(*values)).agg(F.lit(f"{c} in enumeration").alias("rule"), F.count(F.lit(1)).alias("n")))
    key = [k for k in KEYS.get(table, []) if k in df.columns]
    if key:
        parts.append(df.groupBy(*key).count().where("count > 1").agg(F.lit("key " + ", ".join(key)).alias("rule"), F.count(F.lit(1)).alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


def validate(df: DataFrame, table: str) -> DataFrame:
    """df, or ValueError if a rule is broken."""
    broken = violations(df, table).collect()
    if broken:
        raise ValueError(f"{table}: " + "; ".join(f"{r['rule']}: {r['n']}" for r in broken))
    return df
