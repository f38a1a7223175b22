"""Tables bucketed and sorted by key: getters that read one bucket, joins by the key without a shuffle, scans in order."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "esquema string, llave array<string>, orden array<string>, cubetas int, carpeta string"


@dataclass(frozen=True)
class KeyedTable:
    """A table whose rows lie in `buckets` files by the hash of `key`, each sorted by `order` (the key first)."""

    data: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int

    def get(self, *values) -> DataFrame:
        """The rows of one key, in order; only its bucket is read, and of that what the files' statistics leave. A null finds nothing."""
        if len(values) != len(self.key):
            raise ValueError(f"the key has {len(self.key)} columns")
        x = self.data
        for name, value in zip(self.key, values):
            x = x.where(F.col(name) == F.lit(value))
        return x.coalesce(1).sortWithinPartitions(*self.order)  # rows of one bucket

    def get_many(self, keys: DataFrame) -> DataFrame:
        """The rows of all keys of a table (of the key's columns); repeated keys count once, nulls find nothing."""
        return self.data.join(keys.select(*self.key).distinct(), list(self.key), "left_semi")

    def scan(self) -> DataFrame:
        """All rows in order."""
        return self.data.orderBy(*self.order)

    def join(self, other: KeyedTable, how: str = "inner") -> DataFrame:
        """A join by the key of two tables of like keys and buckets: neither side shuffles."""
        if (self.key, self.buckets) != (other.key, other.buckets):
            raise ValueError("the tables' keys or buckets differ")
        return self.data.join(other.data.hint("merge"), list(self.key), how)


def write_keyed(df: DataFrame, path: str, key: tuple[str, ...], buckets: int, order: tuple[str, ...] = ()) -> KeyedTable:
    """Writes df to a new folder below path and records it there as the table's state: readers see the old one until then.

    `buckets` is chosen so that one is what a task holds; a key that very many rows share lies in one bucket, as its getter
    reads it, so keys are to be selective. Rows with a null key lie in a bucket too.
    """
    spark = df.sparkSession
    folder = f"{path}/v-{uuid.uuid4().hex}"
    every = (*key, *[c for c in order if c not in key])
    name = f"llave_{uuid.uuid4().hex}"
    df.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*every).option("path", folder).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # of an outer table the files stay
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.createDataFrame([(fields, list(key), list(every), buckets, folder)], RECORD).coalesce(1).write.mode("overwrite").parquet(f"{path}/registro")
    return open_keyed(spark, path)


def open_keyed(spark: SparkSession, path: str) -> KeyedTable:
    """The table at path, in any session: its buckets are declared anew from the record."""
    r = spark.read.schema(RECORD).parquet(f"{path}/registro").first()
    name = f"llave_{uuid.uuid4().hex}"
    columns = ", ".join
    spark.sql(f"CREATE TABLE {name} ({r.esquema}) USING parquet CLUSTERED BY ({columns(r.llave)}) SORTED BY ({columns(r.orden)}) INTO {r.cubetas} BUCKETS LOCATION '{r.carpeta}'")
    return KeyedTable(spark.table(name), tuple(r.llave), tuple(r.orden), r.cubetas)
