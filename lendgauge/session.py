"""Session helpers: a local session for tests, and lineage cuts that survive lost executors."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder = None


def local_session(cores="*", shuffle_partitions=8, app_name="lendgauge"):
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, which the driver and all executors see.

    Only a local session (tests), whose tasks run in the driver, may do without the setting and gets a temporary folder.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_folder = _own_folder or tempfile.mkdtemp(prefix="lendgauge-shared-")
    return _own_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with its lineage cut."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def new_place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def through_parquet(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new place and read it back."""
    path = new_place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str):
    """Delete a folder that :func:`new_place` named, when nothing reads it any more."""
    if not path.startswith(shared_folder(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} isn't in the shared folder")
    deleted(spark, path)


def _place(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def deleted(spark: SparkSession, path: str):
    """Delete a folder, on whatever file system it is."""
    place, files = _place(spark, path)
    files.delete(place, True)


def finished(spark: SparkSession, folder: str) -> list:
    """Names of the tables in ``folder`` that were written to an end; none if there is no such folder."""
    place, files = _place(spark, folder.rstrip("/") + "/*/_SUCCESS")
    return [status.getPath().getParent().getName() for status in files.globStatus(place) or []]
