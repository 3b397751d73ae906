"""Made-up inputs: a social graph, access traces, and dirty business files."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.paging import PAGE_SIZE, READ_ONLY_PAGES


def social_edges(n: int = 4039, m: int = 22, triad: float = 0.6, seed: int = 42) -> list[tuple[int, int]]:
    """Sorted edges u < v of a graph that grows by attachment to busy nodes, each step followed with some chance by one to a neighbour of the last. Sequential by nature; for tests and benchmarks."""
    if m < 1 or n <= m + 1 or not 0 <= triad <= 1:
        raise ValueError("need m >= 1, n > m + 1, 0 <= triad <= 1")
    draw = random.Random(seed)
    near: list[set[int]] = [set() for _ in range(n)]
    ends: list[int] = list(range(m))
    for new in range(m, n):
        last = None
        while len(near[new]) < min(m, new):
            closer = sorted(near[last] - near[new] - {new}) if last is not None and draw.random() < triad else []
            last = draw.choice(closer) if closer else draw.choice(ends)
            if last != new and last not in near[new]:
                near[new].add(last)
                near[last].add(new)
                ends += [last, new]
    return sorted({(min(u, v), max(u, v)) for u in range(n) for v in near[u]})


def random_edges(spark: SparkSession, scale: int, edges: int, seed: int = 42) -> DataFrame:
    """(src, dst) over 2 ** scale nodes with a few busy ones, made in parallel: each bit of an end is drawn on its own, uneven."""
    bit = lambda k, s: F.when(F.rand(seed + 2 * k + s) < 0.68, 0).otherwise(1 << k)
    ends = [sum((bit(k, s) for k in range(1, scale)), bit(0, s)).cast("long") for s in (0, 1)]
    return spark.range(edges).select(ends[0].alias("src"), ends[1].alias("dst"))


def access_trace(spark: SparkSession, processes: int = 6, accesses: int = 80, seed: int = 7) -> DataFrame:
    """trace(arrival, proc, vaddr, access, seq): seven in ten accesses in a working set of six pages, the rest anywhere, now and then just out of range."""
    r = lambda k: F.rand(seed + k)
    base = spark.range(processes * accesses).select(F.col("id").alias("arrival"), (F.col("id") % processes).cast("int").alias("proc"), F.expr(f"id div {processes}").alias("seq"))
    local = (F.col("proc") * 7 + F.floor(r(1) * 6) * 11) % 64
    page = F.when(r(0) < 0.7, local).otherwise(F.floor(r(2) * 65)).cast("long")
    rows = base.withColumn("page", page)
    write = r(3) < F.when(F.col("page") < READ_ONLY_PAGES, 0.25).otherwise(0.3)
    return rows.select("arrival", "proc", (F.col("page") * PAGE_SIZE + F.floor(r(4) * PAGE_SIZE)).cast("long").alias("vaddr"), F.when(write, "WRITE").otherwise("READ").alias("access"), "seq")


def dirty_customers(spark: SparkSession, n: int = 1000, seed: int = 1) -> DataFrame:
    """Customers with blanks around names, missing codes, stale repeats and missing keys."""
    r = lambda k: F.rand(seed + k)
    blank = lambda c, k: F.when(r(k) < 0.03, F.concat(F.lit(" "), c)).when(r(k) > 0.97, F.concat(c, F.lit(" "))).otherwise(c)
    base = spark.range(n).select(
        (F.col("id") + 11000).cast("int").alias("cst_id"),
        F.format_string("AW%08d", F.col("id") + 11000).alias("cst_key"),
        blank(F.format_string("First%d", F.col("id") % 50), 0).alias("cst_firstname"),
        blank(F.format_string("Last%d", F.col("id") % 70), 1).alias("cst_lastname"),
        F.when(r(2) < 0.02, None).when(r(2) < 0.5, "S").otherwise("M").alias("cst_marital_status"),
        F.when(r(3) < 0.015, None).when(r(3) < 0.5, "F ").otherwise("m").alias("cst_gndr"),
        F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("cst_create_date"),
    )
    stale = base.filter(F.col("cst_id") % 61 == 0).withColumn("cst_create_date", F.date_sub("cst_create_date", 200)).withColumn("cst_firstname", F.lit("Old"))
    lost = base.filter(F.col("cst_id") % 607 == 0).withColumn("cst_id", F.lit(None).cast("int"))
    return base.union(stale).union(lost)
