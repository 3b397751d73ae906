"""Reports: JSON, text tables, durations, load progress, trace logs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of a trace log's lines.
LOG = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{6})\] (\w+) proc=(\d+) page=(-?\d+)(?: paddr=(\d+))?$"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, status, proc, page, paddr) of the lines that have the form of a trace log; rejected() has the others."""
    part = lambda i: F.regexp_extract("value", LOG, i)
    rows = spark.read.text(path).filter(F.col("value").rlike(LOG))
    return rows.select(F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), part(2).alias("status"), part(3).cast("int").alias("proc"), part(4).cast("long").alias("page"), F.nullif(part(5), F.lit("")).cast("long").alias("paddr"))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines that read_log() can't read, blank ones apart."""
    return spark.read.text(path).filter(~F.col("value").rlike(LOG) & (F.trim("value") != ""))


def write_log(lines: DataFrame, path: str) -> None:
    """lines(arrival, value) in order, as text."""
    lines.orderBy("arrival").select("value").write.mode("append").text(path)


def as_json(df: DataFrame) -> DataFrame:
    """(value): one JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def table(headers: list[str], rows: list[tuple]) -> str:
    """A text table with columns as wide as their widest cell."""
    cells = [headers, *[[str(x) for x in r] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(headers))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def preview(df: DataFrame, column: str, limit: int = 20) -> str:
    """The first values, and how many more there are."""
    found = [str(r[0]) for r in df.select(column).limit(limit).collect()]
    more = df.count() - len(found)
    return ", ".join(found) + (f" (+{more} more)" if more else "")


def duration(ns: float) -> str:
    for unit, size in (("s", 1e9), ("ms", 1e6), ("µs", 1e3)):
        if ns >= size:
            return f"{ns / size:.2f} {unit}"
    return f"{ns:.0f} ns"


def timings(samples: DataFrame, name: str, value: str) -> DataFrame:
    """name, mean, median, p95 per name. p95 is the sample at place min(n - 1, floor(0.95 n)) of the sorted ones, from 0; it is not interpolated."""
    from pyspark.sql import Window

    ranked = samples.select(name, value, (F.row_number().over(Window.partitionBy(name).orderBy(value)) - 1).alias("i"), F.count("*").over(Window.partitionBy(name)).alias("n"))
    at = F.least(F.col("n") - 1, F.floor(F.lit(95) * F.col("n") / 100))
    return ranked.groupBy(name).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(F.when(F.col("i") == at, F.col(value))).alias("p95"))


def measured(runs: dict[str, Callable[[], object]], times: int = 3) -> list[tuple[str, float]]:
    """(name, nanoseconds) of each run; a run must end in an action."""
    out = []
    for name, run in runs.items():
        for _ in range(times):
            began = time.perf_counter_ns()
            run()
            out.append((name, float(time.perf_counter_ns() - began)))
    return out


def sidecar(spark: SparkSession, meta: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path)
