"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session without any.

    Executors of a cluster would not see a temporary folder of the driver, so there the
    setting must be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loom-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if there is a file or folder at the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def file_states(spark: SparkSession, files: list[str]) -> list[str]:
    """Path, length and time of change of each file, sorted: other contents, another state."""
    conf, out = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in sorted(files):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        state = at.getFileSystem(conf).getFileStatus(at)
        out.append(f"{name}:{state.getLen()}:{state.getModificationTime()}")
    return out
