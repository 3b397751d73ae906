"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

queries has seconds, the mean where a metric is run several times; spread has mean, median and p95 of those, and the graph's
whole runs on larger graphs, by edges.
"""

from __future__ import annotations

import json
import os
import random
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), *[p for p in [os.environ.get("PYTHONPATH")] if p]])

from pyspark.sql import functions as F  # noqa: E402

from lakeloom.operators import graph as gr  # noqa: E402
from lakeloom.plans import catalogue  # noqa: E402
from lakeloom.runtime import materialize, session  # noqa: E402
from lakeloom.sources import synthetic  # noqa: E402

HEADLINE = [
    "revenue_by_type_year",
    "latest_order_per_customer",
    "order_validity_ranges",
    "repair_amounts",
    "fact_sales_view",
    "orphans_not_exists_or",
    "assemble_offsets",
    "asof_chunk_time",
    "chunk_documents",
    "knn_top20",
    "mmr_top4",
    "lru_stack_distance",
    "mmu_counters",
    "monitor_per_second",
]
LOOKUPS, TIMES, SEED = 10_000, 5, 42
#: Edges of the random graphs of the curve, which is drawn if $BENCH_CURVE is set.
CURVE = (1_000_000, 4_000_000, 16_000_000)


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 4)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def spread(runs: list[float]) -> dict[str, float]:
    """p95 is the sample at place min(n - 1, floor(0.95 n)) of the sorted ones."""
    ordered = sorted(runs)
    return {"mean": round(statistics.fmean(runs), 4), "median": round(statistics.median(runs), 4), "p95": ordered[min(len(runs) - 1, int(0.95 * len(runs)))]}


def graph_runs(spark) -> dict[str, list[float]]:
    """Seconds of each of eleven metrics, on a graph of the size and shape that the baseline's latencies are for."""
    pairs = synthetic.social_edges()
    graph = gr.build(spark.createDataFrame(pairs, "src long, dst long"))
    graph = gr.Graph(materialize(graph.vertices, "bench-vertices"), materialize(graph.edges, "bench-edges"), False)
    draw, n = random.Random(SEED), max(v for _, v in pairs) + 1
    asked = spark.range(LOOKUPS).select(F.pmod(F.hash("id", F.lit(SEED)), F.lit(n)).cast("long").alias("u"), F.pmod(F.hash("id", F.lit(SEED + 1)), F.lit(n)).cast("long").alias("v"))
    node = lambda: draw.randrange(n)
    metrics = {
        "graph_node_lookup": lambda: graph.has_node(node()),
        "graph_node_miss": lambda: graph.has_node(n + node()),
        "graph_edge_lookup": lambda: graph.has_edge(*draw.choice(pairs)),
        "graph_edge_random": lambda: graph.has_edge(node(), node()),
        f"graph_edge_lookup_batch_{LOOKUPS}": lambda: consume(graph.has_edges(asked)),
        "graph_neighbours": lambda: graph.neighbours_of(node()).collect(),
        "graph_bfs": lambda: consume(gr.bfs(graph, node())),
        "graph_dfs": lambda: consume(gr.dfs(graph, node())),
        "graph_shortest_path": lambda: gr.shortest_path(graph, node(), node()),
        "graph_pagerank": lambda: consume(gr.pagerank(graph).scores),
        "graph_wcc": lambda: consume(gr.weak_components(graph)),
        "graph_scc": lambda: consume(gr.strong_components(graph)),
    }
    return {name: [timed(run) for _ in range(TIMES)] for name, run in metrics.items()}


def curve(spark) -> dict[str, dict[str, float]]:
    """Whole runs on random graphs of CURVE edges, by joins and, where the graph is small enough, in one task."""
    found = {}
    for m in CURVE:
        ends = [F.pmod(F.xxhash64("id", F.lit(s)), F.lit(m // 20)).alias(c) for s, c in ((1, "src"), (2, "dst"))]
        graph = gr.build(spark.range(m).select(*ends))
        graph = gr.Graph(materialize(graph.vertices, "bench-vertices"), materialize(graph.edges, "bench-edges"), False)
        for name, limit in (("joins", 0), ("one task", gr.ONE_TASK)):
            if limit == 0 or m <= limit:
                found[f"{m} edges, {name}"] = {"bfs": timed(lambda g=graph, k=limit: consume(gr.bfs_distance(g, 0, one_task=k))), "wcc": timed(lambda g=graph, k=limit: consume(gr.weak_components(g, one_task=k)))}
    return found


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    consume(catalogue.QUERIES["revenue_by_type_year"](spark, sf_dir))  # the session compiles its first code
    times = {name: timed(lambda name=name: consume(catalogue.QUERIES[name](spark, sf_dir))) for name in HEADLINE}
    graphs = graph_runs(spark)
    detail = {name: spread(runs) for name, runs in graphs.items()}
    times |= {name: x["mean"] for name, x in detail.items()}
    if os.environ.get("BENCH_CURVE"):
        detail["curve"] = curve(spark)
    if os.environ.get("BENCH_LLM") and (llm := __import__("__spark_entry__").llm_queries):
        times |= {name: timed(lambda name=name: consume(f(spark, sf_dir))) for name, f in llm.QUERIES.items()}
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"), "spread": detail}))


if __name__ == "__main__":
    main()
