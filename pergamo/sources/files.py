"""Sources and sinks: page files, PDF files, evaluation cases, downloads, remote lists."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamo.functions import text as T
from pergamo.session import ship_code


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, modificationTime, content) of all files below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def digests(files: DataFrame) -> DataFrame:
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), T.volume_of_file(F.col("path")).alias("tomo"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """(tomo, pdf_page, texto, pagina_oficial) of PDF files, one row a page from 1 on. Needs pdfplumber on the executors."""
    ship_code(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    texts = [p.extract_text() or "" for p in pdf.pages]
                if not texts:
                    raise ValueError(f"no pages in {path}")
                yield pd.DataFrame({"path": path, "pdf_page": range(1, len(texts) + 1), "texto": texts})

    raw = files.select("path", "content").mapInPandas(run, "path string, pdf_page int, texto string")
    return raw.select(T.volume_of_file(F.col("path")).alias("tomo"), "pdf_page", "texto", T.official_page(F.col("texto")).alias("pagina_oficial"))


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """Pages from JSON lines (tomo, pdf_page, texto): what any extractor can write."""
    return spark.read.schema("tomo int, pdf_page int, texto string").json(path)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines."""
    return spark.read.schema("consulta string, cita_esperada string, nota string").json(path)


def land_upload(content: bytes, name: str, volume: int, folder: str) -> str:
    """Writes an upload where the file source finds it; only .pdf names."""
    if not name.lower().endswith(".pdf"):
        raise ValueError("only PDF files")
    target = Path(folder) / f"{volume}.pdf"
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(".pdf.partial")
    part.write_bytes(content)
    os.replace(part, target)
    return str(target)


def download(fetch: Callable[[Path], None], target: str, attempts: int = 3, wait: float = 1.0, force: bool = False) -> bool:
    """True if `fetch` had to bring the file, False if it was there; a part never stands under the final name."""
    path = Path(target)
    if path.exists() and not force:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    part, last = path.with_name(path.name + ".partial"), None
    for k in range(1, attempts + 1):
        try:
            fetch(part)
            os.replace(part, path)
            return True
        except OSError as e:
            last = e
            part.unlink(missing_ok=True)
            if k < attempts:
                time.sleep(wait * k)
    raise ConnectionError(f"{target}: {attempts} attempts failed") from last


def download_many(jobs: list[tuple[Callable[[Path], None], str]], pause: float = 1.0, **options) -> list[bool]:
    out = []
    for k, (fetch, target) in enumerate(jobs):
        out.append(download(fetch, target, **options))
        if pause and k + 1 < len(jobs):
            time.sleep(pause)
    return out


def paged_html(spark: SparkSession, fetch: Callable[[int], str], pager: str) -> DataFrame:
    """(pagina, html) of a paged list: `fetch` gets page numbers from 1 until the pager's total."""
    rows, n, total = [], 1, 1
    while n <= total:
        html = fetch(n)
        found = re.search(pager, html)
        if not found:
            raise ValueError(f"page {n} has no pager")
        total = int(found.group(2))
        rows.append((n, html))
        n += 1
    return spark.createDataFrame(rows, "pagina int, html string")


def paged_records(spark: SparkSession, search: Callable[[int, int], int], page: Callable[[int], list[str]], volume: int, first: int) -> DataFrame:
    """(json, tomo, pagina) of all records of a ruling: pages of records until the total, or an empty page."""
    total, rows, k = search(volume, first), [], 0
    while len(rows) < total:
        got = page(k)
        if not got:
            break
        rows += got
        k += 1
    return spark.createDataFrame([(r, volume, first) for r in rows[:total]], "json string, tomo int, pagina int")
