"""Shared folder, written intermediate tables and column names for the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sessionscope-shared-"))
    return context.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written once under the shared folder, so that a lost executor rereads them.

    The tables that a lazy result still reads stay there; drop what was replaced.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame has it."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(frame: DataFrame, column: str = "text") -> Column:
    """A text column, null as empty."""
    return F.coalesce(frame[column].cast("string"), F.lit(""))


def doc_order(doc_id: Column) -> tuple[Column, Column]:
    """Sort keys by document id, null last."""
    return doc_id.isNull(), doc_id
