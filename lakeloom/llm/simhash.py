"""SimHash near-dedup by a self-join of binary tries.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least one of four blocks of 16 bits. Each distinct
fingerprint therefore goes to four tables, turned so that one block comes first; a table is a binary trie, and its work is
cut into pairs of trie nodes, at first each node of depth 16 with itself. A pair of nodes that still holds too many
fingerprints for one task is replaced by the pairs of their descendants six bits further down, as long as the bits in which
the nodes differ stay within the budget. A task keeps its trie as a sorted array, in which a node is a range, and walks
node pairs downwards, adding up differing bits; it drops a pair when the sum exceeds the budget, or when both ranges
already belong to one component, and compares the fingerprints of small pairs. It returns one link for each fingerprint
that joined a component, never all pairs. Components over all tasks come from alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators.components import connected_components
from lakeloom.runtime import materialize, workers_see_package

#: Words in a shingle, and differing bits up to which fingerprints link.
SHINGLE, BUDGET = 3, 3
#: Blocks must outnumber the budget, or pairs would be missed.
BLOCKS, BLOCK_BITS, STEP = 4, 16, 6
#: Fingerprints in one unit of work, before it is cut into pairs of deeper nodes; node pairs of so few pairs are compared.
UNIT, LEAF = 2_000_000, 64
#: Node pairs, or pairs of fingerprints, that are in hand at a time.
BATCH = 400_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint. A-Z is lower-cased; words are what ASCII white space leaves; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return int(np.uint64(xxh64_intdigest(b" ".join(words), 42)).astype(np.int64))
    total = np.zeros(64, dtype=np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, 1 << 16):  # long texts in parts
        part = words[at : at + (1 << 16) + shingle - 1]
        hashes = np.array([xxh64_intdigest(b" ".join(w), 42) for w in zip(*(part[i:] for i in range(shingle)), strict=False)], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0].astype(np.int64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) per row of docs."""
    workers_see_package(docs.sparkSession)
    here = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("t"))
    out = T.StructType([here.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t.as_py(), shingle) for t in batch.column("t")], pa.int64())], out.names)

    return here.mapInArrow(run, out)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (the least index of each index's component) after linking a[i] with b[i]."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(deeper := label[label], label):
            label = deeper


def _walk(keys: np.ndarray, pairs: list[np.ndarray], depth: int, budget: int) -> np.ndarray:
    """Least index of each key's component. keys: sorted uint64. pairs: ranges a, b and differing bits (five arrays); a is b or lies before it."""
    label = np.arange(len(keys))
    stack = [(depth, pairs)]
    while stack:
        depth, now = stack.pop()
        if len(now[0]) > BATCH:
            half = len(now[0]) // 2
            stack += [(depth, [x[half:] for x in now]), (depth, [x[:half] for x in now])]
            continue
        if len(now[0]) * 4 > len(keys):  # worth a look at all labels: ranges of one component need no more
            steps = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            whole = (steps[now[1] - 1] == steps[now[0]]) & (steps[now[3] - 1] == steps[now[2]]) & (label[now[0]] == label[now[2]])
            now = [x[~whole] for x in now]
        a0, a1, b0, b1, err = now
        work = (a1 - a0) * (b1 - b0)
        leaf = (work <= LEAF) | (depth >= 64)
        if leaf.any():
            w, x0, y0, ny = work[leaf], a0[leaf], b0[leaf], (b1 - b0)[leaf]
            if depth >= 64:  # one value each: the nodes link as a whole, and each is one key
                w = np.ones_like(w)
            for part in np.split(np.arange(len(w)), np.flatnonzero(np.diff(np.cumsum(w) // BATCH)) + 1):
                row = np.repeat(part, w[part])
                k = np.arange(len(row)) - np.repeat(np.cumsum(w[part]) - w[part], w[part])
                i, j = x0[row] + k // ny[row], y0[row] + k % ny[row]
                near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
                label = _merge(label, i[near], j[near])
        a0, a1, b0, b1, err = (x[~leaf] for x in now)
        if not len(a0):
            continue
        bit = np.uint64(1 << (63 - depth))
        below = np.uint64((1 << (64 - depth)) - 1)
        am = np.searchsorted(keys, (keys[a0] & ~below) | bit)
        bm = np.searchsorted(keys, (keys[b0] & ~below) | bit)
        am, bm = np.clip(am, a0, a1), np.clip(bm, b0, b1)
        two = a0 != b0
        parts = [(a0, am, b0, bm, err, slice(None)), (am, a1, bm, b1, err, slice(None)), (a0, am, bm, b1, err + 1, slice(None)), (am, a1, b0, bm, err + 1, two)]
        children = [[x[pick] for x in part] for *part, pick in parts]
        children = [np.concatenate(x) for x in zip(*children, strict=True)]
        good = (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= budget)
        if good.any():
            stack.append((depth + 1, [x[good] for x in children]))
    return label


def trie_links(keys: np.ndarray, units: np.ndarray, a: np.ndarray, b: np.ndarray, depth: np.ndarray, budget: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (key, least key of its component) inside each unit. All arrays have a row for each key in a unit; a and b are the unit's nodes, as the first depth bits."""
    links = []
    for d in np.unique(depth):
        at = depth == d
        for table in np.unique(units[at]):
            here = at & (units == table)
            k, x, y = keys[here], a[here], b[here]
            # Units with one node: sorted by key, each is a range.
            one = x == y
            s = np.unique(k[one])
            if len(s) > 1:
                node = s >> np.uint64(64 - d)
                lo = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                hi = np.append(lo[1:], len(s))
                lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
                label = _walk(s, [lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int64)], int(d), budget)
                far = np.flatnonzero(label != np.arange(len(s)))
                links.append((s[far], s[label[far]]))
            # Units with two nodes: one walk over the keys of all of them.
            if not one.all():
                s = np.unique(k[~one])
                node = s >> np.uint64(64 - d)
                pair = np.unique(np.stack([x[~one], y[~one]]), axis=1)
                ranges = [np.searchsorted(node, pair[i].astype(np.uint64), side) for i in (0, 1) for side in ("left", "right")]
                err = np.bitwise_count(pair[0] ^ pair[1]).astype(np.int64)
                good = (ranges[0] < ranges[1]) & (ranges[2] < ranges[3])
                label = _walk(s, [r[good] for r in ranges] + [err[good]], int(d), budget)
                far = np.flatnonzero(label != np.arange(len(s)))
                links.append((s[far], s[label[far]]))
    return links


def _turned(fp: str, block: int) -> str:
    """SQL: the bits of fp turned left so that a block comes first."""
    n = block * BLOCK_BITS
    return f"shiftleft({fp}, {n}) | shiftrightunsigned({fp}, {64 - n})" if n else fp


def links(fps: DataFrame, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """(src, dst): links between distinct fingerprints in column fp that join all within budget bits into components."""
    if budget >= BLOCKS:
        raise ValueError(f"budget must be below {BLOCKS}")
    workers_see_package(fps.sparkSession)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.expr(_turned("fp", i)).alias("key")) for i in range(BLOCKS)])
    rows = fps.select(F.explode(tables).alias("x")).select("x.t", "x.key", F.lit(BLOCK_BITS).alias("d"))
    node = F.expr("shiftrightunsigned(key, 64 - d)")
    rows = rows.withColumn("a", node).withColumn("b", node)
    while True:
        hot = rows.groupBy("t", "a", "b", "d").count().filter((F.col("count") > unit) & (F.col("d") <= 64 - STEP)).select("t", "a", "b", "d", F.lit(True).alias("hot"))
        if hot.isEmpty():
            break
        rows = rows.join(hot, ["t", "a", "b", "d"], "left")
        mine = F.expr(f"shiftrightunsigned(key, 64 - d - {STEP})")
        kin = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << STEP) - 1).cast("long")))
        deep = rows.filter("hot").withColumn("m", mine).withColumn("x", kin)
        first = F.expr("shiftrightunsigned(key, 64 - d) = a")
        other = F.when(first, F.shiftleft("b", STEP)).otherwise(F.shiftleft("a", STEP)).bitwiseOR(F.col("x"))
        deep = deep.withColumn("o", other).filter(F.bit_count(F.col("m").bitwiseXOR(F.col("o"))) <= budget)
        deep = deep.select("t", "key", (F.col("d") + STEP).alias("d"), F.least("m", "o").alias("a"), F.greatest("m", "o").alias("b"))
        rows = materialize(rows.filter("hot is null").select("t", "key", "d", "a", "b").union(deep), "simhash-units")
    out = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, keys, a, b, d in _whole_units(batches, unit):
            for table in np.unique(t):
                here = t == table
                n = np.uint64(int(table) * BLOCK_BITS)
                for pair in trie_links(keys[here], t[here], a[here], b[here], d[here], budget):
                    back = [((x >> n) | (x << (np.uint64(64) - n)) if n else x).view(np.int64) for x in pair]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in back], out.names)

    units = rows.select("t", "key", "d", "a", "b").repartition("t", "a", "b").sortWithinPartitions("t", "d", "a", "b")
    return units.mapInArrow(run, out)


def _whole_units(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(t, key, a, b, d) of sorted rows, in parts of whole units. A part ends with the unit in which it reaches most rows, so it holds less than most rows and one unit."""

    def columns(held: list[pa.RecordBatch]) -> list[np.ndarray]:
        found = [np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("t", "key", "a", "b", "d")]
        return [found[0], *(x.astype(np.int64).view(np.uint64) for x in found[1:4]), found[4]]

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        now = columns(held)
        last = np.ones(n, dtype=bool)
        for x in (now[0], now[2], now[3], now[4]):
            last &= x == x[-1]
        cut = int(np.argmax(last))  # sorted: the last unit begins here
        if cut:
            yield tuple(x[:cut] for x in now)
            names = ("t", "key", "d", "a", "b")
            rest = [now[0][cut:], now[1][cut:].view(np.int64), now[4][cut:], now[2][cut:].view(np.int64), now[3][cut:].view(np.int64)]
            held, n = [pa.RecordBatch.from_arrays([pa.array(x) for x in rest], names)], n - cut
    if held:
        yield tuple(columns(held))


def groups(first: DataFrame, budget: int = BUDGET) -> DataFrame:
    """first (fp, first) plus component: the same for fingerprints that links join. first holds each fp once."""
    joined = connected_components(links(first.select("fp"), budget))
    return first.join(joined.select(F.col("id").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the smallest doc_id reachable over links.

    Null and empty texts have the fingerprint 0, linked like any other. Rows without an id get the component of the rest of
    their group, and null if none of it has an id. Repeated rows are rows of one group. Other columns aren't carried along.
    """
    fps = materialize(fingerprints(docs, doc_id, text, shingle), "simhash-fps")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    first = materialize(first, "simhash-distinct")
    of = materialize(groups(first, budget), "simhash-components")
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.join(least, "component").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def op10(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
