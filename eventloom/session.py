"""Session construction, table access and lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "eventloom", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library relies on (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is absent and the master is local (tests, a single machine) a temporary folder is made and
    kept for the session; a cluster without the setting is an error, since its executors share no local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("eventloom.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-eventloom-")
        spark.conf.set("eventloom.shared.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small or iterated result with a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result as a Parquet table in the shared folder and read it back.

    It survives the loss of executors and takes less room than a row checkpoint. ``drop_written`` removes the tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete every intermediate table that ``written`` left in the shared folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables")
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once an application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-eventloom-')}/eventloom", "zip", package.parent, package.name)
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)
