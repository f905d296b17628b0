"""A session for tests and benches, the folder for checkpoints, and reading a table of a directory."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session in one process may do without: it gets a local one, deleted at its end."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="gleba-checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared folder (``shared_folder``)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def drop_checkpoints(spark: SparkSession) -> None:
    """Deletes what this application has written by ``checkpointed``; frames that are built on it can't be read any more."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        path = context._jvm.org.apache.hadoop.fs.Path(folder.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        context.setCheckpointDir(shared_folder(spark))


def bytes_estimate(df: DataFrame) -> int:
    """Spark's estimate of the size of df, from its plan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def ship(spark: SparkSession) -> None:
    """Makes sure that Python workers can import this package: sends it along once a context, unless they share this process's paths."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    near = context.master.startswith("local[") and (os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if near or getattr(context, "_gleba_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="gleba-")
    path = os.path.join(folder, "gleba.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "gleba")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), root))
    context.addPyFile(path)
    context._gleba_shipped = True
