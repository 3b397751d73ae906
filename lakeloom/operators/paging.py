"""Paging: access traces through a page table with frames that are replaced by global least recent use."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.runtime import workers_see_package

#: Fixed values of the simulated machine.
PAGE_SIZE, PAGES, FRAMES, READ_ONLY_PAGES = 4096, 64, 16, 4

RESPONSE = "arrival long, proc int, seq long, page long, status string, paddr long, evicted_frame int, evicted_proc int, evicted_page long, clock long"


def with_page(trace: DataFrame) -> DataFrame:
    """trace(arrival, proc, vaddr, access, seq) with page and offset."""
    return trace.withColumn("page", F.expr(f"vaddr div {PAGE_SIZE}")).withColumn("offset", F.expr(f"vaddr % {PAGE_SIZE}"))


def segfaults(trace: DataFrame) -> DataFrame:
    return with_page(trace).filter((F.col("page") < 0) | (F.col("page") >= PAGES))


def truncated(trace: DataFrame) -> DataFrame:
    """Each process's accesses up to its first out of range, that one included: it ends there."""
    bad = F.min(F.when((F.col("page") < 0) | (F.col("page") >= PAGES), F.col("arrival"))).over(Window.partitionBy("proc"))
    return with_page(trace).withColumn("__end", bad).filter(F.col("__end").isNull() | (F.col("arrival") <= F.col("__end"))).drop("__end")


@dataclass
class Machine:
    """Page table, frames and counters. step() answers one access; the state can be taken out and put back."""

    clock: int = 0
    frames: list = field(default_factory=lambda: [None] * FRAMES)  # (proc, page, last use, dirty)

    def step(self, arrival: int, proc: int, seq: int, vaddr: int, access: str) -> tuple:
        page, offset = vaddr // PAGE_SIZE, vaddr % PAGE_SIZE
        if not 0 <= page < PAGES:
            return (arrival, proc, seq, page, "SEGFAULT", None, None, None, None, self.clock)
        at = next((i for i, f in enumerate(self.frames) if f and f[:2] == (proc, page)), None)
        victim = (None, None, None)
        if at is None:
            status = "FAULT"
            at = next((i for i, f in enumerate(self.frames) if f is None), None)
            if at is None:
                at = min(range(FRAMES), key=lambda i: (self.frames[i][2], i))
                victim = (at, *self.frames[at][:2])
            self.clock += 1
            self.frames[at] = (proc, page, self.clock, False)  # a fault never marks its page as written
        elif access == "WRITE" and page < READ_ONLY_PAGES:
            status = "VIOLATION"  # no tick, no use
            return (arrival, proc, seq, page, status, None, None, None, None, self.clock)
        else:
            status = "HIT"
            self.clock += 1
            self.frames[at] = (proc, page, self.clock, self.frames[at][3] or access == "WRITE")
        return (arrival, proc, seq, page, status, at * PAGE_SIZE + offset, *victim, self.clock)

    def state(self) -> list:
        return [self.clock, [list(f) if f else None for f in self.frames]]

    @classmethod
    def of(cls, state: list) -> Machine:
        return cls(state[0], [tuple(f) if f else None for f in state[1]])


COLUMNS = [c.split()[0] for c in RESPONSE.split(", ")]


def simulate(trace: DataFrame) -> DataFrame:
    """Responses to trace(arrival, proc, vaddr, access, seq) in order of arrival.

    Frames are shared by all processes, so one machine sees every access in order: this is one task by nature. It streams
    the sorted accesses and holds FRAMES entries, whatever the trace's length.
    """

    workers_see_package(trace.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Machine()
        for b in batches:
            rows = [machine.step(*r) for r in zip(b["arrival"], b["proc"], b["seq"], b["vaddr"], b["access"], strict=True)]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"paddr": "Int64", "evicted_frame": "Int32", "evicted_proc": "Int32", "evicted_page": "Int64"})

    ordered = trace.select("arrival", F.col("proc").cast("int").alias("proc"), F.col("seq").cast("long").alias("seq"), "vaddr", "access").repartitionByRange(1, "arrival").sortWithinPartitions("arrival")
    return ordered.mapInPandas(run, RESPONSE)


def counters(responses: DataFrame) -> DataFrame:
    """total_accesses, total_page_faults, total_violations, frames_in_use: accesses out of range violate but don't count as accesses."""
    status = F.col("status")
    return responses.agg(
        F.count_if(status != "SEGFAULT").alias("total_accesses"),
        F.count_if(status == "FAULT").alias("total_page_faults"),
        F.count_if(status.isin("VIOLATION", "SEGFAULT")).alias("total_violations"),
        F.least(F.lit(FRAMES).cast("long"), F.count_if(status == "FAULT")).alias("frames_in_use"),
    )


def stack_distance_faults(trace: DataFrame, frames: int = FRAMES, block: int = 512) -> DataFrame:
    """trace(arrival, proc, page) with distance and fault: the state machine's faults without a state machine.

    An access faults if its page is new or if frames or more distinct pages were touched since its last touch. These are the
    touches in between whose own next touch lies beyond. Exact for traces without writes to read-only pages. Accesses meet
    by blocks of arrival, each with the blocks that its gap covers, so the join is on equal blocks and its size follows the
    sum of the gaps.
    """
    page = Window.partitionBy("proc", "page").orderBy("arrival")
    touched = trace.select("arrival", "proc", "page", F.lag("arrival").over(page).alias("before"), F.lead("arrival").over(page).alias("after"))
    of = lambda c: F.floor(F.col(c) / block)
    asked = touched.filter(F.col("before").isNotNull()).select("arrival", "before", F.explode(F.sequence(of("before"), of("arrival"))).alias("block"))
    other = touched.select(F.col("arrival").alias("at"), F.coalesce("after", F.lit(2**62)).alias("until"), of("arrival").alias("block"))
    between = asked.join(other, "block").filter((F.col("at") > F.col("before")) & (F.col("at") < F.col("arrival")) & (F.col("until") > F.col("arrival")))
    counted = between.groupBy("arrival").agg(F.count("*").alias("n"))
    joined = touched.join(counted, "arrival", "left")
    distance = F.when(F.col("before").isNotNull(), F.coalesce("n", F.lit(0)))
    return joined.select("arrival", "proc", "page", distance.cast("long").alias("distance"), (F.col("before").isNull() | (F.coalesce("n", F.lit(0)) >= frames)).alias("fault"))


def log_lines(responses: DataFrame, stamp: str = "2024-01-01 00:00:00.000000") -> DataFrame:
    """(arrival, value): one text line per response."""
    what = F.when(F.col("status") == "SEGFAULT", F.format_string("SEGFAULT proc=%d page=%d", "proc", "page")).when(
        F.col("status") == "VIOLATION", F.format_string("VIOLATION proc=%d page=%d", "proc", "page")
    ).otherwise(F.format_string("%s proc=%d page=%d paddr=%d", "status", "proc", "page", "paddr"))
    return responses.select("arrival", F.concat(F.lit(f"[{stamp}] "), what).alias("value"))
