"""Session defaults and the scratch folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pergamo")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(spark.sparkContext, "_pergamo_scratch", None)
        if base is None:
            base = spark.sparkContext._pergamo_scratch = "file://" + tempfile.mkdtemp(prefix="pergamo-")
    return f"{base.rstrip('/')}/pergamo-{spark.sparkContext.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by the columns `by` to two tasks a core at least, for work that costs much a row: tables of few bytes come in few splits and
    shuffles of few bytes are read by few tasks. What is grouped or joined by these columns next needs no shuffle of its own."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *by)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that executors need no installation."""
    context = spark.sparkContext
    if getattr(context, "_pergamo_shipped", False):
        return
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="pergamo-code-")) / "pergamo.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(out))
    context._pergamo_shipped = True
