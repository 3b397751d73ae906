"""Graphs as DataFrames: building, lookups, traversal, ranks and strong components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.components import connected_components
from lakeloom.operators.relational import numbered
from lakeloom.runtime import materialize, workers_see_package

#: A graph of at most so many edges is walked by one task, as a round of jobs takes longer than such a walk: 16 bytes an edge, so tens of megabytes.
ONE_TASK = 2_000_000
#: A level of more nodes is numbered by ranges, a smaller one in one task.
LEVEL = 100_000
DIRECTIONS = ("out", "in", "both")


@dataclass(frozen=True)
class Graph:
    """vertices(id) and edges(src, dst). An undirected graph's edges are there once, with src < dst."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool

    def neighbours(self, direction: str = "out") -> DataFrame:
        """(src, dst): dst is one step from src."""
        if direction not in DIRECTIONS:
            raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if not self.directed:
            return self.edges.union(back)
        return {"out": self.edges, "in": back, "both": self.edges.union(back).distinct()}[direction]

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree) of every vertex."""
        out = self.neighbours("out").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
        in_ = self.neighbours("in").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("in_degree"))
        zero = F.lit(0).cast("long")
        return self.vertices.join(out, "id", "left").join(in_, "id", "left").select("id", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree"))

    def has_node(self, node: int) -> bool:
        return not self.vertices.filter(F.col("id") == node).isEmpty()

    def has_edge(self, u: int, v: int) -> bool:
        a, b = (u, v) if self.directed or u < v else (v, u)
        return not self.edges.filter((F.col("src") == a) & (F.col("dst") == b)).isEmpty()

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """pairs(u, v) with found: many lookups as one join."""
        a, b = (F.col("u"), F.col("v")) if self.directed else (F.least("u", "v"), F.greatest("u", "v"))
        asked = pairs.select("u", "v", a.alias("src"), b.alias("dst"))
        return asked.join(self.edges.withColumn("hit", F.lit(True)), ["src", "dst"], "left").select("u", "v", F.coalesce("hit", F.lit(False)).alias("found"))

    def indexed(self) -> DataFrame:
        """(index, id): vertices numbered from 0 by rising id, without one task that sorts them all."""
        return numbered(self.vertices, ["id"], "index", 0).select("index", "id")

    def dense(self) -> DataFrame:
        """(src, dst) as indexes of indexed()."""
        index = materialize(self.indexed(), "graph-index")
        end = lambda c: index.select(F.col("id").alias(c), F.col("index").alias(f"{c}_index"))
        return self.edges.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_index").alias("src"), F.col("dst_index").alias("dst"))

    def external_id(self, index: int) -> int:
        """The id at an index; IndexError outside 0 to the number of vertices."""
        found = None if index < 0 else self.indexed().filter(F.col("index") == index).first()
        if found is None:
            raise IndexError(index)
        return found.id

    def degree_at(self, index: int) -> tuple[int, int]:
        """Out- and in-degree of the vertex at an index; IndexError outside."""
        node = self.external_id(index)
        return tuple(self.neighbours(d).filter(F.col("src") == node).count() for d in ("out", "in"))

    def neighbours_of(self, node: int, direction: str = "out") -> DataFrame:
        """(id) in order; KeyError if the node isn't there."""
        near = self.neighbours(direction).filter(F.col("src") == node).select(F.col("dst").alias("id")).orderBy("id")
        if not self.has_node(node):
            raise KeyError(node)
        return near

    def adjacency(self, direction: str = "out") -> DataFrame:
        """(id, neighbours): sorted arrays of the vertices that have any."""
        return self.neighbours(direction).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def build(edges: DataFrame, directed: bool = False, nodes: DataFrame | None = None) -> Graph:
    """A graph from (src, dst): loops go but their nodes stay, repeats go (in either order if undirected); nodes (id) adds lone ones."""
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    if nodes is not None:
        ids = ids.union(nodes.select(F.col("id").cast("long")))
    ends = ("src", "dst") if directed else (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return Graph(ids.distinct(), edges.filter("src <> dst").select(*ends).distinct(), directed)


def summary(raw: DataFrame, graph: Graph) -> DataFrame:
    """num_nodes, num_edges, self_loops, duplicates_dropped: one row."""
    loops = F.count_if(F.col("src") == F.col("dst"))
    counts = raw.agg(F.count("*").alias("rows"), loops.alias("self_loops"))
    kept = graph.edges.agg(F.count("*").alias("num_edges"))
    return graph.vertices.agg(F.count("*").alias("num_nodes")).join(kept, F.lit(True)).join(counts, F.lit(True)).select("num_nodes", "num_edges", "self_loops", (F.col("rows") - F.col("self_loops") - F.col("num_edges")).alias("duplicates_dropped"))


def _empty_guard(graph: Graph, *nodes: int) -> None:
    for node in nodes:
        if not graph.has_node(node):
            raise KeyError(node)


def _one_task(edges: DataFrame, limit: int) -> bool:
    """Whether edges are at most limit; no more than that many are looked at."""
    return edges.limit(limit + 1).count() <= limit


def _adjacency(edges: pd.DataFrame) -> dict[int, list[int]]:
    edges = edges.sort_values(["src", "dst"])
    starts = np.flatnonzero(np.diff(edges["src"].to_numpy(), prepend=edges["src"].iloc[0] - 1)) if len(edges) else []
    return {int(k): v.tolist() for k, v in zip(edges["src"].to_numpy()[starts], np.split(edges["dst"].to_numpy(), starts[1:]), strict=True)} if len(edges) else {}


def _walk_levels(source: int, max_depth: int | None, target: int | None):
    """BFS with a queue, for one task."""

    def walk(edges: pd.DataFrame) -> pd.DataFrame:
        after = _adjacency(edges)
        order, parent, distance = [source], {source: None}, {source: 0}
        for node in order:
            if (max_depth is not None and distance[node] >= max_depth) or (target in distance and distance[node] >= distance[target]):
                continue
            for x in after.get(node, ()):
                if x not in distance:
                    distance[x], parent[x] = distance[node] + 1, node
                    order.append(x)
        return pd.DataFrame({"id": order, "distance": [distance[x] for x in order], "ord": range(len(order)), "parent": pd.array([parent[x] for x in order], dtype="Int64")})

    return walk


def _from(graph: Graph, steps: DataFrame, kernel, schema: str, nothing: list[tuple]) -> DataFrame:
    """kernel over all steps in one task; nothing is the result without steps."""
    workers_see_package(graph.edges.sparkSession)
    if steps.isEmpty():
        return graph.edges.sparkSession.createDataFrame(nothing, schema)
    return steps.groupBy(F.lit("all").alias("all")).applyInPandas(lambda df: kernel(df[["src", "dst"]]), schema)


def bfs(graph: Graph, source: int, max_depth: int | None = None, direction: str = "out", target: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(id, distance, ord, parent) of what source reaches, level by level.

    ord is the order of a queue that takes neighbours by rising id: inside a level, by the order of the node that found
    them, then by id. Nodes at max_depth are returned, not expanded. With a target the walk stops at its level. Each level is
    one join of the frontier with the edges, and is written down.
    """
    _empty_guard(graph, source)
    spark = graph.edges.sparkSession
    steps = graph.neighbours(direction)
    if _one_task(steps, one_task):
        return _from(graph, steps, _walk_levels(source, max_depth, target), "id long, distance int, ord long, parent long", [(source, 0, 0, None)])
    steps = materialize(steps, "bfs-edges")
    level = spark.createDataFrame([(source, 0, 0, None)], "id long, distance int, ord long, parent long")
    seen, depth, count = materialize(level, "bfs"), 0, 1
    frontier = seen
    while max_depth is None or depth < max_depth:
        if target is not None and not frontier.filter(F.col("id") == target).isEmpty():
            break
        depth += 1
        found = frontier.select(F.col("id").alias("src"), "ord").join(steps, "src").groupBy(F.col("dst").alias("id")).agg(F.min_by("src", "ord").alias("parent"), F.min("ord").alias("by"))
        found = materialize(found.join(seen.select("id"), "id", "left_anti"), "bfs-level")
        here = found.count()
        if not here:
            break
        if here > LEVEL:
            ranked = numbered(found, ["by", "id"], "ord", count)
        else:
            ranked = found.withColumn("ord", F.row_number().over(Window.orderBy("by", "id")).cast("long") + F.lit(count - 1))
        frontier = materialize(ranked.select("id", F.lit(depth).alias("distance"), "ord", "parent"), "bfs")
        seen, count = seen.unionByName(frontier), count + here
    return seen


def bfs_distance(graph: Graph, source: int, max_depth: int | None = None, direction: str = "out", one_task: int = ONE_TASK) -> DataFrame:
    """(id, distance); no order is kept, so no level is sorted."""
    _empty_guard(graph, source)
    steps = graph.neighbours(direction)
    if _one_task(steps, one_task):
        return bfs(graph, source, max_depth, direction, one_task=one_task).select("id", "distance")
    steps = materialize(steps, "bfs-edges")
    frontier = graph.edges.sparkSession.createDataFrame([(source, 0)], "id long, distance int")
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.select(F.col("id").alias("src")).join(steps, "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialize(found.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reach(walked: DataFrame) -> DataFrame:
    """nodes, depth: how many nodes a walk of bfs() or bfs_distance() reached, and the greatest distance."""
    return walked.agg(F.count("*").alias("nodes"), F.max("distance").alias("depth"))


def shortest_path(graph: Graph, source: int, target: int, direction: str = "out", one_task: int = ONE_TASK) -> list[int] | None:
    """Nodes of a path with the fewest steps, each found by the earliest; None if there is none."""
    _empty_guard(graph, source, target)
    if source == target:
        return [source]
    steps = graph.neighbours(direction)
    if _one_task(steps, one_task):
        # The task that walks also walks back, and returns the path alone.
        rows = _from(graph, steps, _walk_back(source, target), "step long, id long", []).orderBy("step").collect()
        return [r.id for r in rows] or None
    found = materialize(bfs(graph, source, direction=direction, target=target, one_task=one_task), "path")
    path, node = [], target
    while node is not None:  # a job per step of the path; the tree stays distributed
        step = found.filter(F.col("id") == node).first()
        if step is None:
            return None
        path.append(node)
        node = step.parent
    return path[::-1]


def _walk_back(source: int, target: int):
    levels = _walk_levels(source, None, target)

    def walk(edges: pd.DataFrame) -> pd.DataFrame:
        found = levels(edges).set_index("id")["parent"]
        path, node = [], target if target in found.index else None
        while node is not None:
            path.append(node)
            node = None if pd.isna(found[node]) else int(found[node])
        return pd.DataFrame({"step": range(len(path)), "id": path[::-1]}).astype("int64")

    return walk


def dfs(graph: Graph, source: int, direction: str = "out", one_task: int = ONE_TASK) -> DataFrame:
    """(id, ord) in pre-order, neighbours by rising id.

    The order is sequential by nature: the part that source reaches is found by distributed steps, and one task walks it
    with an explicit stack. It must fit in that task's memory.
    """
    _empty_guard(graph, source)
    near = graph.neighbours(direction)
    if not _one_task(near, one_task):
        reached = bfs_distance(graph, source, direction=direction).select("id")
        near = near.join(reached.withColumnRenamed("id", "src"), "src", "left_semi")

    def walk(edges: pd.DataFrame) -> pd.DataFrame:
        after = _adjacency(edges)
        seen, order, stack = set(), [], [source]
        while stack:
            node = stack.pop()
            if node not in seen:
                seen.add(node)
                order.append(node)
                stack.extend(x for x in reversed(after.get(node, ())) if x not in seen)
        return pd.DataFrame({"id": order, "ord": range(len(order))})

    return _from(graph, near, walk, "id long, ord long", [(source, 0)])


@dataclass(frozen=True)
class Ranks:
    scores: DataFrame  # id, score
    iterations: int
    converged: bool


def _rank_in_one_task(nodes: np.ndarray, edges: pd.DataFrame, damping: float, tol: float, max_iter: int) -> tuple[np.ndarray, int, bool]:
    n = len(nodes)
    src, dst = (np.searchsorted(nodes, edges[c].to_numpy()) for c in ("src", "dst"))
    degree = np.bincount(src, minlength=n)
    score = np.full(n, 1.0 / n)
    for i in range(1, max_iter + 1):
        gift = np.divide(score, degree, out=np.zeros(n), where=degree > 0)
        new = (1.0 - damping) / n + damping * score[degree == 0].sum() / n + damping * np.bincount(dst, gift[src], n)
        change, score = np.abs(new - score).sum(), new
        if change < tol:
            return score, i, True
    return score, max_iter, False


def pagerank(graph: Graph, damping: float = 0.85, tol: float = 1e-9, max_iter: int = 200, one_task: int = ONE_TASK) -> Ranks:
    """Uniform start and teleport; what nodes without out-edges hold goes to all alike; stops when the sum of changes is below tol."""
    if not 0 < damping < 1 or tol <= 0 or max_iter < 1:
        raise ValueError("damping must be above 0 and below 1, tol positive, max_iter at least 1")
    n = graph.vertices.count()
    if not n:
        return Ranks(graph.vertices.withColumn("score", F.lit(0.0)), 0, True)
    if n <= one_task and _one_task(graph.edges, one_task // 2):
        workers_see_package(graph.edges.sparkSession)
        rows = graph.vertices.select("id", F.lit(None).cast("long").alias("dst")).union(graph.neighbours("out"))

        def run(df: pd.DataFrame) -> pd.DataFrame:
            edges = df[df["dst"].notna()].rename(columns={"id": "src"}).astype("int64")
            nodes = np.sort(df.loc[df["dst"].isna(), "id"].to_numpy())
            score, rounds, converged = _rank_in_one_task(nodes, edges, damping, tol, max_iter)
            return pd.DataFrame({"id": nodes, "score": score, "rounds": rounds, "converged": converged})

        found = materialize(rows.groupBy(F.lit("all").alias("all")).applyInPandas(lambda df: run(df[["id", "dst"]]), "id long, score double, rounds int, converged boolean"), "pagerank")
        said = found.select("rounds", "converged").first()
        return Ranks(found.select("id", "score"), said.rounds, said.converged)
    degree = graph.neighbours("out").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    nodes = materialize(graph.vertices.join(degree, "id", "left"), "pagerank-nodes")
    steps = materialize(graph.neighbours("out"), "pagerank-edges")
    ranks = nodes.withColumn("score", F.lit(1.0 / n))
    lone = ranks.filter("degree is null").agg(F.sum("score")).first()[0] or 0.0
    for i in range(1, max_iter + 1):
        gifts = ranks.filter("degree is not null").select(F.col("id").alias("src"), (F.col("score") / F.col("degree")).alias("gift")).join(steps, "src")
        sums = gifts.groupBy(F.col("dst").alias("id")).agg(F.sum("gift").alias("got"))
        base = (1.0 - damping) / n + damping * lone / n
        new = F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        ranks = materialize(ranks.withColumnRenamed("score", "old").join(sums, "id", "left").select("id", "degree", new.alias("score"), F.abs(new - F.col("old")).alias("change")), "pagerank")
        change, lone = ranks.agg(F.sum("change"), F.sum(F.when(F.col("degree").isNull(), F.col("score")))).first()
        lone = lone or 0.0
        ranks = ranks.drop("change")
        if change < tol:
            return Ranks(ranks.select("id", "score"), i, True)
    return Ranks(ranks.select("id", "score"), max_iter, False)


def _weak_in_one_task(edges: pd.DataFrame) -> pd.DataFrame:
    nodes, both = np.unique(edges[["src", "dst"]].to_numpy(), return_inverse=True)
    src, dst = both.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:  # hook greater roots to lesser ones, then flatten
        a, b = label[src], label[dst]
        if (a == b).all():
            return pd.DataFrame({"id": nodes, "component": nodes[label]})
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(deeper := label[label], label):
            label = deeper


def weak_components(graph: Graph, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) of all vertices; component is the smallest id in it."""
    if _one_task(graph.edges, one_task):
        found = _from(graph, graph.edges, _weak_in_one_task, "id long, component long", [])
    else:
        found = connected_components(graph.edges)
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_components(graph: Graph, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) of all vertices; component is the smallest id in it.

    Nodes without an in- or out-edge among those left are components of their own and are trimmed. Then the smallest id that
    reaches a node colours it; those that reach the colour's root back inside the colour are one component, and leave. With
    at most one_task edges left, one task finishes by the same rule.
    """
    edges = graph.edges if graph.directed else graph.neighbours("both")
    if _one_task(edges, one_task):
        found = _from(graph, edges, _strong_in_one_task, "id long, component long", [])
        return graph.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    edges = materialize(edges, "scc-edges")
    left = materialize(graph.vertices, "scc-left")
    done: list[DataFrame] = []
    while True:
        while True:  # trim
            core = left.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            core = materialize(core, "scc-core")
            lone = materialize(left.join(core, "id", "left_anti").select("id", F.col("id").alias("component")), "scc-done")
            if lone.isEmpty():
                break
            done.append(lone)
            left = core
            edges = _inside(edges, left)
        size = edges.count()
        if not size:
            break
        if size <= one_task:
            done.append(_from(graph, edges, _strong_in_one_task, "id long, component long", []))
            break
        colour = _spread(left.select("id", F.col("id").alias("colour")), edges)
        coloured = edges.join(colour.withColumnRenamed("id", "src").withColumnRenamed("colour", "a"), "src").join(colour.withColumnRenamed("id", "dst").withColumnRenamed("colour", "b"), "dst").filter("a = b")
        back = materialize(coloured.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-back")
        reached = frontier = materialize(colour.filter("id = colour"), "scc-roots")
        while not frontier.isEmpty():
            found = frontier.withColumnRenamed("id", "src").join(back, "src").select(F.col("dst").alias("id"), "colour").distinct()
            frontier = materialize(found.join(reached.select("id"), "id", "left_anti"), "scc-reached")
            reached = reached.unionByName(frontier)
        done.append(materialize(reached.select("id", F.col("colour").alias("component")), "scc-done"))
        left = materialize(left.join(reached.select("id"), "id", "left_anti"), "scc-left")
        edges = _inside(edges, left)
    out = graph.vertices.limit(0).select("id", F.col("id").alias("component"))
    for part in done:
        out = out.unionByName(part)
    return out


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return materialize(edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "scc-edges")


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest colour that reaches each node."""
    while True:
        sent = colour.withColumnRenamed("id", "src").join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("new"))
        after = materialize(colour.join(sent, "id", "left").select("id", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("moved")), "scc-colour")
        colour = after.select("id", "colour")
        if after.filter("moved").isEmpty():
            return colour


def _strong_in_one_task(edges: pd.DataFrame) -> pd.DataFrame:
    """Strong components of one task's edges: two passes of depth-first search with explicit stacks, the second over turned edges."""
    out = _adjacency(edges)
    into = _adjacency(edges.rename(columns={"src": "dst", "dst": "src"}))
    nodes = sorted(set(edges["src"]) | set(edges["dst"]))
    seen: set[int] = set()
    finished: list[int] = []
    for root in nodes:
        stack = [(root, iter(out.get(root, ())))] if root not in seen else []
        seen.add(root)
        while stack:
            node, ahead = stack[-1]
            step = next((x for x in ahead if x not in seen), None)
            if step is None:
                finished.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(out.get(step, ()))))
    component: dict[int, int] = {}
    for root in reversed(finished):
        if root in component:
            continue
        members, stack = [], [root]
        component[root] = root
        while stack:
            node = stack.pop()
            members.append(node)
            for x in into.get(node, ()):
                if x not in component:
                    component[x] = root
                    stack.append(x)
        least = min(members)
        for x in members:
            component[x] = least
    return pd.DataFrame({"id": list(component), "component": list(component.values())})


def sizes(components: DataFrame, first: int | None = None) -> DataFrame:
    """(component, size); the first so many from the largest on, if a number is given."""
    found = components.groupBy("component").agg(F.count("*").alias("size"))
    return found if first is None else found.orderBy(F.desc("size"), "component").limit(first)


def largest(components: DataFrame) -> DataFrame:
    """The largest component, the smallest label among equals, with its share of all nodes in percent and the number of components."""
    each = sizes(components)
    all_ = each.agg(F.count("*").alias("components"), F.sum("size").alias("nodes"))
    first = each.orderBy(F.desc("size"), "component").limit(1)
    return first.join(all_, F.lit(True)).select("component", "size", "components", F.round(100 * F.col("size") / F.col("nodes"), 1).alias("percent"))


@dataclass(frozen=True)
class Analysis:
    """What analyse() finds: the best ranked vertices (place, id, score), and a row each of largest()."""

    top: DataFrame
    iterations: int
    converged: bool
    weak: DataFrame
    strong: DataFrame


def analyse(graph: Graph, k: int = 10, damping: float = 0.85, tol: float = 1e-9, max_iter: int = 200, one_task: int = ONE_TASK) -> Analysis:
    """PageRank's first k and both kinds of components, in one go."""
    ranks = pagerank(graph, damping, tol, max_iter, one_task)
    best = ranks.scores.orderBy(F.desc("score"), "id").limit(k)
    best = best.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("place"), "id", "score")  # k rows
    return Analysis(best, ranks.iterations, ranks.converged, largest(weak_components(graph, one_task)), largest(strong_components(graph, one_task)))
