"""Session settings, table loading and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on; a session that sets its own keeps them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "lodestrata", memory: str = "8g", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the engine's settings; on a cluster, pass the cluster's own session instead."""
    b = SparkSession.builder.master(master).appName(app).config("spark.driver.memory", memory)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession, root: str) -> None:
    """Sends the package to the Python workers, unless they find it by their working directory or PYTHONPATH."""
    if os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_lodestrata_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lodestrata-"), "lodestrata"), "zip", root, "lodestrata")
    sc.addPyFile(archive)
    sc._lodestrata_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores, for work in Python on a scan of few files.

    A scan that has as many partitions by itself, as any large one, is left as it is.
    """
    plan = df._jdf.queryExecution()
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # it has a shuffle already
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if plan.toRdd().getNumPartitions() < cores else df


def partitions_of(df: DataFrame) -> int:
    """How many partitions the rows have; those that a shuffle may have, where there is one."""
    plan = df._jdf.queryExecution()
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plan.toRdd().getNumPartitions()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one if all runs in one process, as in tests; a cluster must name one."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestrata-"))
        at = sc.getCheckpointDir()
    return at


class Workspace:
    """Intermediate tables in the shared folder: each cuts the lineage and survives the loss of executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/ws-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def split(self, df: DataFrame, name: str, flag: str) -> tuple[DataFrame, DataFrame]:
        """The rows where flag holds and those where it does not, without the flag, written once; drop() takes name/flag=true or name/flag=false."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").partitionBy(flag).parquet(path)
        schema = df.drop(flag).schema
        return tuple(self._part(f"{path}/{flag}={x}", schema) for x in ("true", "false"))

    def _part(self, path: str, schema) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.base}/{name}")

    def clear(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the session has ended already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
