"""Reading tables, Arrow mapping and string hashing shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pergamo.session import ship_code

#: Bytes of text handled at once in one worker: bounds the arrays beside an Arrow batch.
CHUNK = 4_000_000
#: Rows of an Arrow batch, and so what a mapping function and the buffers on both sides of it hold at once.
ROWS = 1000


def apply(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow where the workers have this package, in batches of ROWS rows."""
    ship_code(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return df.mapInArrow(fn, schema)


_held: dict[str, tuple[object, object]] = {}


def hold(name: str, key: object = None, build: Callable[[], object] | None = None) -> object:
    """What a worker process keeps between tasks: the tables and caches of one operator at a time.

    Asked for under another name or key, the old ones go first, so operators that follow each other in one
    application don't add up in a worker's memory.
    """
    if name not in _held or _held[name][0] != key:
        _held.clear()
        _held[name] = (key, build() if build else None)
    return _held[name][1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """One output batch for each ROWS rows of input, so what a batch needs beside itself stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                yield fn(b.slice(at, ROWS))

    return apply(df, run, schema)


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` characters together; a longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64, in place of a slow hash per item."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
