"""Saved models and statistics: each save is a new folder, made valid by one line in a manifest.

A save that breaks off leaves files that no manifest names, so the version before it stays readable whole; readers
never see parts of two saves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number bigint, folder string, batch string"


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The saves below ``path``, one row each; None where nothing was saved."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(number, folder) of the last complete save; (0, None) without one."""
    saves = manifest(spark, path)
    row = saves.agg(F.max(F.struct("number", "folder")).alias("m")).first()["m"] if saves is not None else None
    return (row["number"], f"{path}/versions/{row['folder']}") if row else (0, None)


def folder_of(spark: SparkSession, path: str) -> str:
    """Folder of the last complete save."""
    folder = newest(spark, path)[1]
    if folder is None:
        raise FileNotFoundError(f"nothing was saved in {path}")
    return folder


def has_batch(spark: SparkSession, path: str, batch: str) -> bool:
    saves = manifest(spark, path)
    return saves is not None and not saves.where(F.col("batch") == batch).isEmpty()


def commit(spark: SparkSession, path: str, write: Callable[[str], None], batch: str | None = None) -> None:
    """Let ``write`` fill a new folder, then name it in the manifest."""
    number = newest(spark, path)[0] + 1
    name = f"{number}-{uuid.uuid4().hex}"
    write(f"{path}/versions/{name}")
    line = spark.range(1).select(F.lit(number).cast("bigint").alias("number"), F.lit(name).alias("folder"), F.lit(batch).cast("string").alias("batch"))
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
