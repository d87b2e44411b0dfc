"""Tables written between the steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_FOLDERS: set[str] = set()


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _folder(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; where that is unset, a temporary folder if all is one machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="orbweave-"))
        named = _OWN[0]
    folder = f"{named.rstrip('/')}/states-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        path, system = _hadoop(spark, folder)
        system.deleteOnExit(path)
    return folder


class States:
    """The last table written of an iteration; the one before it goes when the next is there."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, ""

    def written(self, df: DataFrame) -> DataFrame:
        path, before = f"{_folder(self.spark)}/{uuid.uuid4().hex}", self.path
        df.write.parquet(path)
        self.path = path
        if before:
            old, system = _hadoop(self.spark, before)
            system.delete(old, True)
        return self.spark.read.schema(df.schema).parquet(path)
