"""Tables in between, in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillframe.errors import InvalidParameterError

_written = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one on a single machine, and an error on several."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise InvalidParameterError("the executors share no folder: set spark.checkpoint.dir to one", "spark.checkpoint.dir", root)
        root = "file://" + tempfile.mkdtemp(prefix="quillframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def durable(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses none of it.

    The folder goes when the session's JVM ends, or with the ``settled`` that it was written in.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    for step in getattr(_written, "steps", [])[-1:]:
        step.append(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """durable(make()); the tables that making it wrote are deleted, as nothing else can refer to them."""
    steps = vars(_written).setdefault("steps", [])
    steps.append([])
    try:
        df = durable(make())
    except BaseException:
        steps.pop()
        raise
    *between, own = steps.pop()
    files = own.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    for path in between:
        files.delete(path, True)
    for step in steps[-1:]:
        step.append(own)
    return df
