"""Plain files in shared storage, read and written by executors through Arrow.

Executors have no Hadoop configuration, so the driver names a folder by ``located`` first:
a path without a scheme belongs to Hadoop's default file system, as everywhere in Spark.
Hadoop's names of S3 are Arrow's ``s3``.  What Arrow cannot open (a scheme it lacks, HDFS
without its client library) is an error on the driver, before anything is written.
"""

from __future__ import annotations

import re

from pyarrow import ArrowInvalid, fs
from pyspark.sql import SparkSession

# Schemes of Hadoop that Arrow knows by another name.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def located(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host that Spark gives it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = system.makeQualified(place).toString()
    try:
        _located(full)
    except (ArrowInvalid, OSError) as error:
        raise ValueError(f"Archives and token files cannot be kept at {full}: Arrow cannot open this file system.") from error
    return full


def _located(path: str) -> tuple[fs.FileSystem, str]:
    scheme, rest = re.fullmatch(r"(?:([a-zA-Z][\w.+-]*):)?(.*)", path, re.DOTALL).groups()
    if scheme == "file":
        # Hadoop writes file:/a, other tools file:///a; neither encodes blanks.
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme is None:
        raise ValueError(f"{path} has no scheme; name the folder by located() on the driver.")
    return fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest}")


def open_output(path: str):
    system, place = _located(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    return system.open_output_stream(place, compression=None)


def open_input(path: str):
    """A seekable file."""
    system, place = _located(path)
    return system.open_input_file(place)


def open_stream(path: str):
    """A file read from front to back."""
    system, place = _located(path)
    return system.open_input_stream(place, compression=None)
