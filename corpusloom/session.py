"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    place = tempfile.mkdtemp(prefix="corpusloom-")  # the driver serves the archive from here while it runs
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    copy = Path(place, "copy", _PACKAGE.name)
    shutil.copytree(_PACKAGE, copy, ignore=shutil.ignore_patterns("__pycache__", "*.new"))
    sc.addPyFile(shutil.make_archive(str(Path(place, _PACKAGE.name)), "zip", copy.parent))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share; a local one only where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = named or tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(place)
        drop_at_end(spark, sc.getCheckpointDir() if named else place)  # the application's own folder in it
    return named or sc.getCheckpointDir()


def drop_at_end(spark: SparkSession, path: str) -> None:
    """The folder is deleted when the application ends."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one for what lives no longer than the application."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    drop_at_end(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared checkpoint folder: survives lost executors and cuts lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
