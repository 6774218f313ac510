"""Read-through cache of computed views as Parquet folders."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def view_name(base: str, views: Sequence[str], granularity: float) -> str:
    """A view's folder: base, its views and the granularity's whole part."""
    return re.sub(r"[^\w.-]", "_", "_".join([base, *views, str(int(granularity))]))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached_view(spark: SparkSession, folder: str, name: str, compute: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The stored view, or `compute()` stored and read back. Only folders whose writing was completed count."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if refresh or not _exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
