"""Results that several later plans read, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def saved(what: Any, name: str = "table") -> Any:
    """A DataFrame, or a table with roles, written as Parquet under ``spark.checkpoint.dir`` and read back.

    Later uses read the file: nothing is worked out again, and lost executors
    lose nothing.  Where the setting is unset, as in local mode, a temporary
    folder serves; on a cluster that is an error.
    """
    if not isinstance(what, DataFrame):
        return replace(what, df=saved(what.df, name))
    spark = what.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="seriesloom-"))
    path = f"{base}/seriesloom/{uuid.uuid4().hex}-{name}"
    what.write.parquet(path)
    return spark.read.schema(what.schema).parquet(path)
