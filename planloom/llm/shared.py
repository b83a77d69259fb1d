"""Folders and files that all executors and the driver see."""

from __future__ import annotations

import os
import re
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.session import checkpoint_dir


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    For sessions whose workers start in another folder. Where the package is installed,
    or its path doesn't exist on a worker's machine, this changes nothing.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder beside the checkpoints of the session."""
    top = re.sub(r"^file:/(?!/)", "file:///", checkpoint_dir(spark)).rstrip("/")
    return f"{top}/{name}-{uuid.uuid4().hex}"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def make_folder(uri: str) -> str:
    """``uri``, once its folder exists."""
    store, path = _opened(uri)
    store.create_dir(path, recursive=True)
    return uri


def write_file(folder: str, name: str, parts) -> None:
    """Write a file under a hidden name of its own, then rename it.

    A task that runs again replaces the file by equal content; readers never see half
    a file, and Spark's readers skip names that begin with an underscore.
    """
    store, path = _opened(folder)
    hidden = f"{path}/_{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        for part in parts:
            out.write(part)
    store.move(hidden, f"{path}/{name}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: columnar, and without its lineage."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def packed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in one column ``row``, so that no working column can clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
