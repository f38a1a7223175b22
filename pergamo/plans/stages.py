"""The ingest as stages over Parquet tables, with a manifest that makes reruns resume.

Each stage reads tables, works on all volumes at once and overwrites the partitions of the volumes it had. The
manifest gets a row a volume and stage after the data is written, so a crash in between leads to a rerun that
writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamo.operators import chunks as C
from pergamo.operators import citations, pages, rulings, sections, vectors
from pergamo.schemas import SCHEMAS

# States in order and the stage that leads to each.
STATES = ("registrado", "descargado", "extraido", "limpio", "segmentado", "estructurado", "fragmentado", "embebido", "indexado")
STAGES = ("descargar", "extraer", "limpiar", "segmentar", "estructurar", "fragmentar", "embeber", "indexar")
PARKED = "requiere_ocr"
ATTEMPTS = 3


def next_stage(state: str, quality: str = "desconocida") -> str | None:
    """What a volume in this state needs next; a scan is parked once its text is extracted."""
    at = STATES.index(state)
    return None if at == len(STAGES) or (state == "extraido" and quality == PARKED) else STAGES[at]


def progress(state: str) -> float:
    return STATES.index(state) / len(STAGES)


@dataclass
class Workspace:
    """Tables under one folder, partitioned by volume where they are large."""

    spark: SparkSession
    path: str
    model: vectors.EmbeddingModel = field(default_factory=vectors.HashedProjection)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(self._schema(table)).parquet(f"{self.path}/{table}") if self.exists(table) else self.spark.createDataFrame([], self._schema(table))

    def _schema(self, table: str) -> str:
        extra = {"fallos": ", pagina_siguiente int, pagina_fin_cuerpo int, metodo string, dudosa boolean, paginas array<struct<pagina_oficial:int,texto:string>>, texto string", "secciones": ", tomo int", "chunks": ", tomo int", "vectores": ", tomo int", "citas": ", sitio int, lugar int, tomo int", "paginas": ", texto string", "tomos": ", tomo int"}
        return SCHEMAS.get(table, "") + extra.get(table, "") if table in SCHEMAS else "tomo int, caratula string, paginas array<int>"

    def exists(self, table: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def write(self, table: str, df: DataFrame) -> None:
        """Replaces the partitions of the volumes in df."""
        fields = self.spark.createDataFrame([], self._schema(table))
        out = fields.unionByName(df.select(*[c for c in fields.columns if c in df.columns]), allowMissingColumns=True)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tomo").parquet(f"{self.path}/{table}")

    def mark(self, volumes: list[int], stage: str, state: str, error: str | None = None) -> None:
        rows = [(int(v), stage, state, 1, error) for v in volumes]
        self.spark.createDataFrame(rows, "tomo int, etapa string, estado string, intentos int, error string").withColumn("terminado_at", F.date_trunc("second", F.current_timestamp())).coalesce(1).write.mode("append").parquet(f"{self.path}/etapas")

    def done(self) -> dict[int, set[str]]:
        """Stages that each volume has behind it; as many numbers as there are volumes."""
        out: dict[int, set[str]] = {}
        for r in self.read("etapas").where("estado = 'hecho'").select("tomo", "etapa").distinct().collect():
            out.setdefault(r["tomo"], set()).add(r["etapa"])
        return out

    def failures(self) -> dict[tuple[int, str], int]:
        return {(r["tomo"], r["etapa"]): r["n"] for r in self.read("etapas").where("estado = 'fallido'").groupBy("tomo", "etapa").agg(F.count(F.lit(1)).alias("n")).collect()}


def _of(df: DataFrame, volumes: list[int]) -> DataFrame:
    return df.where(F.col("tomo").isin(*volumes))


def extract(w: Workspace, volumes: list[int]) -> None:
    """Official numbers of the pages, and of each volume what its pages tell: quality, pages and the offset that links need."""
    w.write("paginas", pages.with_official_page(_of(w.read("paginas"), volumes)))
    w.write("tomos", pages.volume_rows(_of(w.read("paginas"), volumes)))


def clean(w: Workspace, volumes: list[int]) -> None:
    got = _of(w.read("paginas"), volumes)
    if got.isEmpty():
        raise ValueError("no pages were extracted")
    w.write("paginas", pages.with_clean_text(got))


def segment(w: Workspace, volumes: list[int]) -> None:
    w.write("fallos", rulings.check_segments(rulings.segment(_of(w.read("indice"), volumes), _of(w.read("paginas"), volumes))))


def structure(w: Workspace, volumes: list[int]) -> None:
    base = _of(w.read("fallos"), volumes).drop("paginas", "texto", "fecha", "jueces", "tipo_recurso", "tribunal_origen", "actor", "demandado", "actor_tipo", "demandado_tipo")
    w.write("fallos", rulings.with_metadata(rulings.ruling_texts(base, _of(w.read("paginas"), volumes))))
    w.write("citas", citations.extract(_of(w.read("fallos"), volumes)).join(_of(w.read("fallos"), volumes).select("cita", "tomo"), "cita"))


def chunk(w: Workspace, volumes: list[int]) -> None:
    texts = _of(w.read("fallos"), volumes).where("pagina_inicio is not null and cita is not null")
    volume = texts.select("cita", "tomo")
    w.write("secciones", sections.sections(texts).join(volume, "cita"))
    w.write("chunks", C.chunk_sections(_of(w.read("secciones"), volumes), texts).join(volume, "cita"))


def embed(w: Workspace, volumes: list[int]) -> None:
    """Only chunks without a vector of the model are embedded; the others keep theirs."""
    wanted, have = _of(w.read("chunks"), volumes), _of(w.read("vectores"), volumes)
    fresh = vectors.embed(vectors.pending(wanted, have, w.model.name), w.model).join(wanted.select("chunk_id", "tomo"), "chunk_id")
    kept = have.where(F.col("modelo") == w.model.name).join(wanted.select("chunk_id"), "chunk_id", "left_semi")
    w.write("vectores", kept.unionByName(fresh.select(*kept.columns)))


def seal(w: Workspace, volumes: list[int]) -> None:
    vectors.check_complete(_of(w.read("chunks"), volumes), _of(w.read("vectores"), volumes))


HANDLERS: dict[str, Callable[[Workspace, list[int]], None]] = {"extraer": extract, "limpiar": clean, "segmentar": segment, "estructurar": structure, "fragmentar": chunk, "embeber": embed, "indexar": seal}


def register(w: Workspace, page_rows: DataFrame, entries: DataFrame | None = None) -> list[int]:
    """Takes in pages (tomo, pdf_page, texto) and index entries of new volumes, or again of known ones."""
    w.write("paginas", page_rows)
    if entries is not None:
        w.write("indice", entries)
    found = [r["tomo"] for r in page_rows.select("tomo").distinct().collect()]
    w.mark(found, "descargar", "hecho")
    return found


def _attempt(w: Workspace, stage: str, volumes: list[int]) -> list[int]:
    """Runs a stage for all volumes together, and where that fails for each half of them alone, so that a bad volume
    is marked with its own error and holds up no other. Returns those that passed; raises if none did."""
    errors: list[Exception] = []

    def part(some: list[int]) -> list[int]:
        try:
            HANDLERS[stage](w, some)
            return some
        except Exception as e:
            if len(some) > 1:
                half = len(some) // 2
                return part(some[:half]) + part(some[half:])
            w.mark(some, stage, "fallido", str(e)[:500])
            errors.append(e)
            return []

    passed = part(volumes)
    if errors and not passed:
        raise errors[0]
    return passed


def run(w: Workspace, volumes: list[int] | None = None, force: bool = False) -> dict[int, str]:
    """Brings volumes as far as they go and tells where each stands; a stage that failed ATTEMPTS
    times needs force. A volume that fails stays where it is; the others go on."""
    done = w.done()
    volumes = sorted(done) if volumes is None else volumes
    quality = {r["tomo"]: r["calidad"] for r in pages.page_quality(_of(w.read("paginas"), volumes)).collect()}
    failed = w.failures()
    for k, stage in enumerate(STAGES[1:], 1):
        ready = [v for v in volumes if STAGES[k - 1] in done.get(v, ()) and stage not in done[v] and not (k >= 2 and quality.get(v) == PARKED) and (force or failed.get((v, stage), 0) < ATTEMPTS)]
        if not ready:
            continue
        passed = _attempt(w, stage, ready)
        w.mark(passed, stage, "hecho")
        for v in passed:
            done[v].add(stage)
    return {v: STATES[sum(s in done.get(v, ()) for s in STAGES)] for v in volumes}


def status(w: Workspace) -> DataFrame:
    """Per volume: stages done, share of the way, rulings, chunks, its own last error."""
    log = w.read("etapas")
    steps = log.where("estado = 'hecho'").groupBy("tomo").agg(F.count_distinct("etapa").alias("etapas"))
    last = log.groupBy("tomo").agg(F.max_by("estado", "terminado_at").alias("ultimo"), F.max_by("error", "terminado_at").alias("error"))
    count = lambda t: w.read(t).groupBy("tomo").agg(F.count(F.lit(1)).alias(t))
    out = steps.join(last, "tomo").join(count("fallos"), "tomo", "left").join(count("chunks"), "tomo", "left")
    return out.withColumn("avance", F.col("etapas") / len(STAGES)).fillna(0, ["fallos", "chunks"])
