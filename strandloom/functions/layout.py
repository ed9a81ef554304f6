"""How rows lie over tasks, and where scratch data go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The scratch folder that driver and executors share: ``spark.checkpoint.dir``, or else the context's
    checkpoint folder. Where neither is set, a local session gets a folder of its own, and a cluster,
    whose machines share no local folder, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return _OWN["dir"]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def spread(df: DataFrame, mb_a_core: int = 64) -> DataFrame:
    """A table of few files and little data dealt over all cores: one row group is one task's, however
    long each row's work takes. Larger tables, and those of as many files as cores, stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if len(df.inputFiles()) < cores and size < cores * mb_a_core << 20 else df
