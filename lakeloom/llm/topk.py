"""Exact top-k inner products by aggregation of sorted lists without random access.

Each component of the vectors is a list, sorted by what it adds to a query's score: from its greatest value down for queries
whose component is positive, from its least up for the others. The lists of a block of vectors are read in step, a part of
each at a time. A vector's score is at most what was read of it plus, for each list where it hasn't come yet, the last value
read there; it is at least that with the list's least value instead. Both bounds are kept for all queries of a block at once,
as products of matrices. Reading stops for a query when the k-th best lower bound, or the k-th best score of earlier blocks,
is above what unread vectors can reach and few vectors could still qualify; these get their final scores.

Vectors are cut into blocks, a block is one task's work, and queries pass it by in batches: vectors move once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.runtime import materialize, workers_see_package

K, SCALE, QUERY_EVERY = 5, 256, 50
#: Vectors in a block, in a part of a block whose lists are read together, and queries at a time.
BLOCK, PART, QUERIES = 32_768, 8_192, 512
#: How far the lists are read before bounds are looked at, again and again, as parts of their length.
DEPTHS = (0.25, 0.45, 0.65, 0.85)
#: Reading ends for a query when at most this part of the vectors could still qualify.
FEW = 0.02


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): distinct rows with v = floor(scale * x). Rows without an id, null vectors and those with null or non-finite components go."""
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("e"))
    whole = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.coalesce(whole, F.lit(False)))
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v")).distinct()


def scores(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact inner products of whole numbers, of any size; one that a long can't hold is an error."""
    most = int(np.abs(vectors).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(1, vectors.shape[1])
    if most < 2**53:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64).tolist()
    if most < 2**63:
        return (vectors @ query).tolist()
    found = [sum(int(x) * int(y) for x, y in zip(v, query, strict=True)) for v in vectors]
    if any(not -(2**63) <= s < 2**63 for s in found):
        raise OverflowError("an inner product is beyond the range of long")
    return found


class Lists:
    """The sorted lists of a part of the vectors."""

    def __init__(self, part: np.ndarray):
        self.part, self.exact = part.astype(np.float64), part
        n, self.width = part.shape
        order = np.argsort(part, axis=0, kind="stable")
        self.place = np.empty_like(order)  # of each vector in each list, from the least value on
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(n)[:, None], (n, self.width)), axis=0)
        self.sorted = np.take_along_axis(self.part, order, axis=0)

    def read(self, since: int, depth: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """What the entries from since to depth add to the scores. up and down: the positive and the negative components of queries, as columns."""
        n = len(self.part)
        top = (self.place >= n - depth) & (self.place < n - since)
        low = (self.place >= since) & (self.place < depth)
        return np.where(top, self.part, 0.0) @ up + np.where(low, self.part, 0.0) @ down

    def unread(self, depth: int, up: np.ndarray, down: np.ndarray, best: bool) -> np.ndarray:
        """What lists add at most (or at least) to vectors that haven't come in them, for each vector and query."""
        n = len(self.part)
        hide_top, hide_low = (self.place < n - depth).astype(np.float64), (self.place >= depth).astype(np.float64)
        if best:
            return (hide_top * self.sorted[n - depth]) @ up + (hide_low * self.sorted[depth - 1]) @ down
        return (hide_top * self.sorted[0]) @ up + (hide_low * self.sorted[n - 1]) @ down

    def front(self, depth: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """What a vector that came in no list can reach, for each query."""
        n = len(self.part)
        return self.sorted[n - depth] @ up + self.sorted[depth - 1] @ down


class Best:
    """The k best of each query of a batch so far, as (-score, id), sorted."""

    def __init__(self, n: int, k: int):
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.k = k

    def bar(self) -> np.ndarray:
        """The k-th best score of each query, minus infinity where there are fewer."""
        return np.array([float(-r[self.k - 1][0]) if len(r) >= self.k else -np.inf for r in self.rows])

    def add(self, i: int, found: list[tuple[int, int]]) -> None:
        self.rows[i] = sorted(self.rows[i] + found)[: self.k]


def search(lists: Lists, own: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best) -> None:
    """Adds the k best of a part of the vectors (own: their ids) to the best of each query, ties to smaller ids."""
    n, k = len(own), best.k
    q = queries.T.astype(np.float64)
    up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
    # Sums of floats are off by less than this; whole numbers below 2 ** 53 aren't off at all.
    reach = np.abs(lists.part).max(axis=0, initial=0.0) @ np.abs(q)
    slack = np.where(reach < 2.0**52, 0.0, reach * (lists.width + 2) * 2.0**-50)
    open_ = np.arange(len(query_ids))
    seen = np.zeros((n, len(open_)))
    bar, since = best.bar(), 0
    for part in DEPTHS:
        depth = max(1, int(n * part))
        u, d = up[:, open_], down[:, open_]
        seen += lists.read(since, depth, u, d)
        since = depth
        # k + 1 of the lower bounds, as the query's own row may be one of them.
        lower = seen + lists.unread(depth, u, d, best=False)
        mine = np.partition(lower, n - k - 1, axis=0)[n - k - 1] if n > k else np.full(len(open_), -np.inf)
        least = np.maximum(bar[open_], mine - slack[open_])
        upper = seen + lists.unread(depth, u, d, best=True) + slack[open_]
        left = upper >= least
        count = left.sum(axis=0)
        done = (lists.front(depth, u, d) + slack[open_] < least) & (count <= max(8, n * FEW))
        for c in np.flatnonzero(done):
            _resolve(lists, own, queries, query_ids, best, int(open_[c]), np.flatnonzero(left[:, c]))
        open_, seen = open_[~done], seen[:, ~done]
        if not len(open_):
            return
    # The lists are read to their ends: all scores are final.
    u, d = up[:, open_], down[:, open_]
    seen += lists.read(since, n, u, d)
    top = np.partition(seen, n - k - 1, axis=0)[n - k - 1] if n > k else np.full(len(open_), -np.inf)
    least = np.maximum(bar[open_], top - slack[open_])
    for c, i in enumerate(open_):
        _resolve(lists, own, queries, query_ids, best, int(i), np.flatnonzero(seen[:, c] + slack[i] >= least[c]))


def _resolve(lists: Lists, own: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best, i: int, left: np.ndarray) -> None:
    """Final scores of the vectors that are left, for query i."""
    left = left[own[left] != query_ids[i]]
    if len(left):
        best.add(i, [(-s, int(x)) for s, x in zip(scores(lists.exact[left], queries[i]), own[left], strict=True)])


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones are filled with zeros."""
    lengths = rows.value_lengths().to_numpy()
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, queries_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of rows for each of queries; both have vec_id long and v array<long>.

    A row isn't compared with the query of its own id. Ties go to the smaller id. Vectors of different lengths are compared
    as if the shorter one ended in zeros. Of equal vectors only the k + 1 smallest ids can be among the k best, so the rest
    is left out before anything is compared. Fewer rows than k give fewer results, an empty table none. A score that a long
    can't hold is an error.
    """
    workers_see_package(rows.sparkSession)
    copies = Window.partitionBy("v").orderBy("vec_id")
    rows = materialize(rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"), "topk-rows")
    queries = materialize(queries, "topk-queries")
    n = max(1, -(-rows.count() // block))
    width = max(x.agg(F.max(F.size("v"))).first()[0] or 0 for x in (rows, queries))
    vectors = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    out = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, asks, parts = None, [], [], None

        def searched() -> pa.RecordBatch:
            nonlocal parts
            if parts is None:  # the vectors of a block came before its queries
                ids, whole = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                parts = [(ids[i : i + PART], Lists(whole[i : i + PART])) for i in range(0, len(ids), PART)]
                held.clear()
            query_ids, q = np.concatenate([x for x, _ in asks]), np.concatenate([x for _, x in asks])
            asks.clear()
            best = Best(len(query_ids), k)
            for ids, lists in parts:
                search(lists, ids, q, query_ids, best)
            found = [(int(a), vec, -score) for a, r in zip(query_ids, best.rows, strict=True) for score, vec in r]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], out)

        for batch in batches:
            place = batch.column("block").to_numpy()
            kind = batch.column("asks").to_numpy(zero_copy_only=False)
            for at in np.split(np.arange(len(place)), np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1):
                if not len(at):
                    continue
                if place[at[0]] != now:
                    if asks:
                        yield searched()
                    now, held, asks, parts = place[at[0]], [], [], None
                piece = batch.slice(at[0], len(at))
                row = piece.column("vec_id").to_numpy(), _matrix(piece.column("v"), width)
                if not kind[at[0]]:
                    held.append(row)
                elif held or parts:
                    for i in range(0, len(at), queries_block):
                        if sum(len(x) for x, _ in asks) >= queries_block:
                            yield searched()
                        asks.append((row[0][i : i + queries_block], row[1][i : i + queries_block]))
        if asks:
            yield searched()

    dealt = vectors.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every vector whose id is divisible by 50."""
    rows = materialize(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "topk-integers")
    return top_k(rows, rows.filter(F.col("vec_id") % QUERY_EVERY == 0))


OP8_SQL = f"""
WITH r AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM r q JOIN r c ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
