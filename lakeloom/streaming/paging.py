"""The paging machine as a stream, and running counters."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeloom.operators.paging import COLUMNS, RESPONSE, Machine, log_lines
from lakeloom.runtime import workers_see_package

#: One state for all accesses, as frames are shared; it is a few hundred bytes.
STATE = "machine string"


def respond(trace: DataFrame) -> DataFrame:
    """A stream of trace(arrival, proc, vaddr, access, seq) answered in order of arrival inside each batch; batches must come in order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine.of(json.loads(state.get[0])) if state.exists else Machine()
        rows = pd.concat(list(frames)).sort_values("arrival")
        out = [machine.step(*(int(x) if not isinstance(x, str) else x for x in r)) for r in zip(rows["arrival"], rows["proc"], rows["seq"], rows["vaddr"], rows["access"], strict=True)]
        state.update((json.dumps(machine.state()),))
        yield pd.DataFrame(out, columns=COLUMNS).astype({"paddr": "Int64", "evicted_frame": "Int32", "evicted_proc": "Int32", "evicted_page": "Int64"})

    workers_see_package(trace.sparkSession)
    return trace.withColumn("machine", F.lit("all")).groupBy("machine").applyInPandasWithState(step, RESPONSE, STATE, "append", GroupStateTimeout.NoTimeout)


def snapshot(responses: DataFrame) -> DataFrame:
    """Running totals of a response stream, for a sink in complete mode."""
    return responses.groupBy().agg(
        F.count_if(F.col("status") != "SEGFAULT").alias("total_accesses"),
        F.count_if(F.col("status") == "FAULT").alias("total_page_faults"),
        F.count_if(F.col("status").isin("VIOLATION", "SEGFAULT")).alias("total_violations"),
    )


def drain(responses: DataFrame, path: str, checkpoint: str) -> None:
    """Answers everything that is there, appends it as Parquet and ends; run again, it goes on after that."""
    query = responses.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def requests(spark: SparkSession, path: str, schema, in_flight: int = 4):
    """A stream of trace files, at most in_flight of them in a batch: what comes in waits while a batch is answered."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", in_flight).parquet(path)


def log_sink(responses: DataFrame, path: str, checkpoint: str):
    """A started query that appends one line of text per response, with the time of its batch."""
    stamped = log_lines(responses).select(F.concat(F.lit("["), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("] "), F.regexp_replace("value", r"^\[[^\]]*\] ", "")).alias("value"))
    return stamped.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def monitor(responses: DataFrame, checkpoint: str, seconds: int = 1, sink: str = "console", name: str = "paging_monitor"):
    """A started query that shows the running totals every so many seconds."""
    shown = snapshot(responses).writeStream.outputMode("complete").queryName(name).option("checkpointLocation", checkpoint)
    return shown.format(sink).trigger(processingTime=f"{seconds} seconds").start()
