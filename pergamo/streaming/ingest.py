"""Structured Streaming: new page files into the workspace, new chunks into the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pergamo.operators import vectors
from pergamo.plans import stages


PAGE_LINE = "tomo int, pdf_page int, texto string"


def new_files(spark: SparkSession, folder: str, pattern: str = "*.jsonl", late: str | None = None) -> DataFrame:
    """(path, modificationTime, sha256, content) of files that arrive anywhere below folder, each content once.

    A file is known by the SHA-256 of its bytes, not by its name: a copy, and a file that was moved or renamed, is not taken again,
    also after a restart from the checkpoint, which holds the hashes. `late` bounds that state: hashes are forgotten when
    files so much younger have come. Empty files are never taken; one that is filled later under its name isn't either, as it was
    seen. Give whole files to the folder by renaming them into it.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrived = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    known = arrived.where("length > 0").select("path", "modificationTime", F.sha2("content", 256).alias("sha256"), "content")
    return known.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"]) if late else known.dropDuplicates(["sha256"])


def pages_of(files: DataFrame) -> DataFrame:
    """(tomo, pdf_page, texto) from files of one JSON object a line; blank lines and broken ones, which lack a volume or a page, are left out."""
    lines = files.select(F.explode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("line")).where("trim(line) <> ''")
    return lines.select(F.from_json("line", PAGE_LINE).alias("p")).select("p.*").where("tomo is not null and pdf_page is not null")


def watch_pages(spark: SparkSession, folder: str, workspace: stages.Workspace, checkpoint: str) -> StreamingQuery:
    """Ingests each batch of JSON line files of pages that arrived, each content once; batches without pages are skipped."""

    def ingest(batch: DataFrame, _: int) -> None:
        pages = pages_of(batch)
        if not pages.isEmpty():
            stages.run(workspace, stages.register(workspace, pages))

    return new_files(spark, folder).writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_chunks(spark: SparkSession, chunks_path: str, schema: str, workspace: stages.Workspace, checkpoint: str) -> StreamingQuery:
    """Embeds the chunks that arrived and upserts them: a batch that runs again writes the same rows."""
    arrived = spark.readStream.schema(schema).parquet(chunks_path)

    def upsert(batch: DataFrame, _: int) -> None:
        have = workspace.read("vectores")
        new = vectors.embed(batch, workspace.model).join(batch.select("chunk_id", "tomo"), "chunk_id")
        touched = have.join(batch.select("tomo").distinct(), "tomo", "left_semi").select("chunk_id", "modelo", "vector", "tomo")
        workspace.write("vectores", vectors.upsert(touched, new, workspace.model.dim))

    return arrived.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type and window of event time; works on streams, with a watermark, and on tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("desde"), "event_type", "n", "total")
