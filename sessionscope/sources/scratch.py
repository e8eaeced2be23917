"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; a local session makes one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sessionscope-shared-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


class Stored:
    """A frame written once; whatever is lost later is reread from it and not computed again.

    ``table`` reads it.  Lazy results need the files until they are consumed, so ``drop`` is the caller's call.
    """

    def __init__(self, frame: DataFrame, name: str):
        self.spark = frame.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        frame.write.parquet(self.path)
        self.table = self.spark.read.schema(frame.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
