"""Session, shared storage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 8 << 20

#: Environment of Python workers: Arrow takes memory from the C library, which has one arena and gives free memory back.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1000000"}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the queries expect; conf overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(master).appName("lakeloom")
    return builder.config(map=settings | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where the setting is absent (one machine, as in tests) a temporary folder of this machine is set instead.
    """
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not there:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = tempfile.mkdtemp(prefix="lakeloom-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        context.setCheckpointDir(f"file://{there}")
        there = f"file://{there}"
    return there


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage is cut, and a lost executor costs no recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows, measured as text and with row_bytes more each, come to at most limit; else df, so that the join shuffles."""
    text = F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    rows, size = df.agg(F.count("*"), F.sum(text)).first()
    return F.broadcast(df) if rows * row_bytes + (size or 0) <= limit else df


def workers_see_package(spark: SparkSession) -> None:
    """Python workers started from now on find this package even if the driver runs in another folder, and give memory back that they have freed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, os.environ.get(name, value))


def read(spark: SparkSession, sf_dir: str, *tables: str) -> list[DataFrame]:
    workers_see_package(spark)
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables]
