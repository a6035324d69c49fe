"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Runtime settings every job relies on: AQE re-plans joins from measured sizes
# and splits skewed join partitions even when that costs an extra shuffle.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a batch of long texts stays within a Python worker's memory
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once per application: they need not share
    the driver's Python path. Spark's own file server carries it."""
    context = spark.sparkContext
    if getattr(context, "_wardlight_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="wardlight-ship-"), "wardlight.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    context._wardlight_shipped = True


def tune(spark: SparkSession) -> SparkSession:
    ship(spark)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "wardlight", cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by the cluster in
    ``spark.checkpoint.dir``. Only a local-mode session may fall back to a
    temporary folder of this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="wardlight-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialise(df):
    """Write ``df`` once to the shared folder and read it back, so that later
    passes see the same rows and a lost executor does not rerun its lineage."""
    spark = df.sparkSession
    shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df):
    """``df`` as a table of its own in the shared folder: written once like
    :func:`materialise`, but by column, so that later passes read only what they need."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def mounted(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder on a mounted file system, None in other stores."""
    there, files = _hadoop(spark, path)
    where = files.makeQualified(there).toUri()
    return where.getPath() if where.getScheme() == "file" else None


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on any file system Spark can read."""
    there, files = _hadoop(spark, path)
    return files.exists(there)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    there, files = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(there) if s.isDirectory()) if files.exists(there) else []


def remove(spark: SparkSession, path: str) -> None:
    there, files = _hadoop(spark, path)
    files.delete(there, True)
