"""Session helpers: the shared checkpoint folder and materialised intermediates."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the workers once an application, so that they can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="docflow-")) / "docflow.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where the session sets it, else one of our own (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="docflow-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact spelling; of several columns of a name the first. Other columns, whatever their names, don't interfere."""
    columns = df.columns
    missing = [n for n in names if n not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.toDF(*(f"_{i}" for i in range(len(columns)))).select(*(F.col(f"_{columns.index(n)}").alias(n) for n in names))


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan with at least a partition for each core, hashed by keys if given; one that has them is left as it is.

    Only scans and narrow steps on them are touched: small files would otherwise put costly expressions into one task.
    """
    if scan._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # it has exchanges, which asking for partitions would run
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *keys)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back, which cuts the lineage.

    A lost executor re-reads the files; nothing lives only in an executor's memory or local disk.
    """
    path = f"{shared_dir(df.sparkSession)}/docflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must stay small; more than limit rows is an error, never a silent cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows
