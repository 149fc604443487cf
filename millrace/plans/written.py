"""Tables and indexes that queries read but don't write each time: made once for a session and folder of tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from millrace.sources.shared import shared_folder

_MADE: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, d: str, name: str, make: Callable[[str], object]) -> str:
    """The folder that `make` has filled for these tables in this session."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MADE:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        make(path)
        _MADE[key] = path
    return _MADE[key]
