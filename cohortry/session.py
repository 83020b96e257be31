"""Session settings and stage tables.

A *stage table* is an intermediate result written as parquet to the shared checkpoint
folder and read back. It cuts the lineage (a lost executor re-reads files instead of
re-running the whole job), keeps column pruning and gives the optimizer file sizes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cohortry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; the caller's settings win."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_signature(spark: SparkSession, folder: str) -> str:
    """Paths, sizes and times of all files under ``folder``, part files of tables too: a stale stage is
    never served."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return "|".join(sorted(found))


_STAGES: dict[tuple, DataFrame] = {}


def stage(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], spec: object = None) -> DataFrame:
    """Build a stage table once per application, input state and ``spec`` (the parameters it is built with)."""
    key = (spark.sparkContext.applicationId, folder, input_signature(spark, folder), name, repr(spec))
    if key not in _STAGES:
        _STAGES[key] = materialise(build(), name)
    return _STAGES[key]


def forget_stages() -> None:
    """Drop the memo (used when timing a cold build)."""
    _STAGES.clear()


def release_stages(spark: SparkSession) -> None:
    """Delete this application's stage tables from the checkpoint folder."""
    forget_stages()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/{_folder(spark)}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession) -> str:
    return f"stages-{spark.sparkContext.applicationId}"
