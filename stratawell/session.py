"""Sessions, code shipping and shared scratch tables.

Scratch tables go below ``spark.checkpoint.dir`` (a folder that the driver and
all executors share) and are removed when the driver's JVM ends.  Only when the
setting is absent, as in local tests, a local folder stands in for it.
"""

from __future__ import annotations

import gc
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def local_session(cores: int = 8, partitions: int = 8, name: str = "stratawell") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per application and bounds Arrow batches."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp(prefix="stratawell-code-"))
        target = folder / "stratawell_code.zip"
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        target.write_bytes(buffer.getvalue())
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    for k, v in ARROW_BATCH.items():
        spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is configured and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stratawell-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/stratawell-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    where, system = _place(spark, path)
    system.deleteOnExit(where)
    return path


def stash(df: DataFrame, tag: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(*tables: DataFrame | None) -> None:
    """Deletes stashed tables that nothing reads any more; frames that stash() did not return are left alone."""
    for df in tables:
        if df is not None and (path := getattr(df, "_stashed_at", None)):
            where, system = _place(df.sparkSession, path)
            system.delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now; else they stay until the driver collects its garbage.

    The scheduler's threads hold the last job they saw, so a tiny one comes first.
    """
    gc.collect()
    spark.range(0, 1, 1, 1).collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
