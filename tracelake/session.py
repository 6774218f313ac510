"""Session helpers: building one for tests, reading tables, cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", app: str = "tracelake", **conf: str) -> SparkSession:
    """A session with the settings the queries expect (UTC, AQE). On a cluster, bring your own session."""
    b = SparkSession.builder.master(master).appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, so it needn't be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tracelake-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "tracelake.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(at, f)
                    z.write(path, os.path.join("tracelake", os.path.relpath(path, root)))
    sc.addPyFile(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder. Zone-less timestamps are taken as UTC."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of this application's checkpoints: in the one the session names in spark.checkpoint.dir; only where none is set (local
    tests) a temporary one is made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        conf = sc.getConf().get("spark.checkpoint.dir", None)
        if conf is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            conf = tempfile.mkdtemp(prefix="tracelake-checkpoint-")
            atexit.register(shutil.rmtree, conf, ignore_errors=True)
        sc.setCheckpointDir(conf)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` once in the shared checkpoint folder and cut its lineage. The files survive the loss of executors.

    They are removed by `scratch`, or by Spark once nothing refers to them, where the session sets
    spark.cleaner.referenceTracking.cleanCheckpoints (as `build_session` does).
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new name beside the checkpoints, for tables that are written and read again."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written once to a scratch folder as Parquet and read back: like `cut`, for what is read several times, each time a few columns or rows of it."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut or written to a scratch folder inside is removed at the end, so results have to be written inside too."""
    sc = spark.sparkContext
    outer = checkpoint_folder(spark)
    sc.setCheckpointDir(os.path.dirname(outer))
    inner = checkpoint_folder(spark)
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(inner)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        sc.setCheckpointDir(os.path.dirname(outer))


def is_small(df: DataFrame, rows: int, sure_bytes: int = 64 << 10, most_bytes: int = 64 << 20) -> bool:
    """Whether `df`, which has different keys, has at most `rows` rows and they take at most `most_bytes`, so it may be broadcast.

    No job is needed where the optimizer knows that its sources hold at most `sure_bytes` (and no key takes less
    than a byte of those); else its rows and the bytes of their texts are counted.
    """
    if rows >= sure_bytes and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= sure_bytes:
        return True
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    each = sum(texts, F.lit(16 * (len(df.columns) + 1)).cast("long"))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(each), F.lit(0))).first()
    return n <= rows and size <= most_bytes


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
