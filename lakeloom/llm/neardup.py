"""One document of each group of near-duplicates: SimHash groups, then Jaccard similarity of shingles of five words.

One pass over the texts gives each its SimHash fingerprint and BANDS keys, each made of the least values of its shingles of
five words under ROWS permutations. Fingerprints are joined by tries (simhash.py). Of what stays, texts that share a key are
candidates; two texts of similarity 0.8 share none with a probability of (1 - 0.8 ** ROWS) ** BANDS, 3e-5. Each candidate is
compared exactly with the least text of every set that shares a key; this joins most sets into one component. The other sets
are compared in full, in units of at most two blocks, as far as their texts aren't joined. Only candidates send their
shingles, and only documents that go, with a few others, leave their place (sift.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm import simhash
from lakeloom.llm.sift import marked, row_key
from lakeloom.operators.components import connected_components
from lakeloom.runtime import materialize, workers_see_package

#: Words in a shingle, and the similarity from which texts link.
SHINGLE, SIMILARITY = 5, 0.8
#: Keys of a text, and permutations in a key.
BANDS, ROWS = 20, 4
#: Texts in a block of a set: a unit of work holds at most two blocks.
BLOCK = 256
#: Shingles whose permutations are in hand at a time.
PART = 2_048

_DRAW = np.random.default_rng(5)
_TURN, _SHIFT = (_DRAW.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_TURN |= np.uint64(1)
_PLACE = _DRAW.integers(0, 2**64, max(SHINGLE, ROWS), dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes; fewer than five words are one shingle. Words are those of SimHash."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    h = np.fromiter((xxh64_intdigest(w, 42) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        total += h[i : i + n] * _PLACE[i]
    return np.unique(_mixed(total))


def keys(grams: np.ndarray) -> np.ndarray:
    """The BANDS keys of a text's shingles."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(grams), PART):
        turned = _TURN[:, None] * grams[None, at : at + PART] + _SHIFT[:, None]
        least = np.minimum(least, turned.min(axis=1))
    return _mixed((_mixed(least).reshape(BANDS, ROWS) * _PLACE[:ROWS]).sum(axis=1, dtype=np.uint64)).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of SIMILARITY or more."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def joined(grams: list[np.ndarray], label: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """Least index of each text's component. Texts of one label are joined already; pairs of one side are left out, if sides are given."""
    n = len(grams)
    label = np.arange(n) if label is None else np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]
    size = np.array([len(g) for g in grams])
    for i in range(1, n):
        may = np.minimum(size[:i], size[i]) >= SIMILARITY * np.maximum(size[:i], size[i])
        if side is not None:
            may &= side[:i] != side[i]
        rest = np.flatnonzero(may)
        while len(rest := rest[label[rest] != label[i]]):
            j, rest = rest[0], rest[1:]
            if alike(grams[i], grams[j]):
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return label


def _map_texts(rows: DataFrame, name: str, make) -> DataFrame:
    """(key, name: array of long) per row of rows (key, t), make() giving the array of a text."""
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField(name, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [make(t.as_py()).view(np.int64) for t in part.column("t")]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.list_(pa.int64()))], out.names)

    return rows.select("key", "t").mapInArrow(run, out)


def _compared(pairs: DataFrame) -> DataFrame:
    """(src, dst) of the pairs (src, dst, x, y) whose shingles x and y are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [alike(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["src", "dst"]).filter(pa.array(same, pa.bool_()))

    return pairs.mapInArrow(run, "src long, dst long")


def links(marks: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst), numbers of documents: links that join all candidates of similarity SIMILARITY or more into components.

    marks: (n, key, keys), each n and key once. texts: (key, t), which may hold more keys and may hold them repeatedly, with
    one text.
    """
    workers_see_package(marks.sparkSession)
    buckets = marks.select("n", F.posexplode("keys").alias("band", "value")).select("n", F.xxhash64("band", "value").alias("bucket"))
    centres = buckets.groupBy("bucket").agg(F.min("n").alias("centre"), F.count("*").alias("size")).filter("size > 1")
    members = materialize(buckets.join(centres, "bucket").select("bucket", "centre", "n", "size"), "neardup-members")
    asked = materialize(members.select("n").distinct().join(marks.select("n", "key"), "n"), "neardup-asked")
    likely = marked(texts.select("key", "t"), asked).filter("maybe")
    grams = _map_texts(likely, "grams", shingles).join(asked, "key").groupBy("n").agg(F.first("grams").alias("grams"))
    grams = materialize(grams, "neardup-grams")
    stars = members.filter("n != centre").select(F.col("centre").alias("src"), F.col("n").alias("dst")).distinct()
    stars = stars.join(grams.select(F.col("n").alias("dst"), F.col("grams").alias("y")), "dst").join(grams.select(F.col("n").alias("src"), F.col("grams").alias("x")), "src")
    near = materialize(_compared(stars.select("src", "dst", "x", "y")), "neardup-stars")
    # A text's label is the least of those that it is known to be joined with by a link, or by two. Sets of three or more whose
    # labels differ are left; sets alike in all members are one.
    least = near.groupBy(F.col("dst").alias("n")).agg(F.min("src").alias("label"))
    above = least.select(F.col("n").alias("label"), F.col("label").alias("above"))
    least = least.join(above, "label", "left").select("n", F.coalesce("above", "label").alias("label"))
    members = members.filter("size > 2").join(least, "n", "left").withColumn("label", F.coalesce("label", "n"))
    members = materialize(members, "neardup-labels")
    open_ = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("size").alias("size"), F.bit_xor(F.xxhash64("n")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "n")).alias("r"))
    open_ = open_.filter("lo != hi").groupBy("size", "s", "r").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    units = members.join(open_, "bucket").withColumn("block", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "n", "label")
    units = units.join(grams, "n").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def found() -> pa.RecordBatch:
            n, label, side = (np.array([r[i] for r in rows]) for i in range(3))
            first, place = np.unique(label, return_index=True, return_inverse=True)[1:]
            new = joined([r[3] for r in rows], label, side if now[1] != now[2] else None)
            far = np.flatnonzero(new != first[place])
            return pa.RecordBatch.from_arrays([pa.array(n[far], pa.int64()), pa.array(n[new[far]], pa.int64())], ["src", "dst"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "n", "label", "block")]
            for *key, one, label, block, own in zip(*columns, batch.column("grams"), strict=True):
                if key != now:
                    if len(rows) > 1:
                        yield found()
                    now, rows = key, []
                rows.append((one, label, block, own.values.to_numpy().copy()))
        if len(rows) > 1:
            yield found()

    return near.union(units.mapInArrow(run, "src long, dst long"))


def _marks(rows: DataFrame) -> DataFrame:
    """(key, id, fp, keys, n) per row of rows (key, id, t), written down: SimHash fingerprint, keys of five-word shingles, both from one pass over the texts, and a number."""
    out = T.StructType([rows.schema["key"], rows.schema["id"], T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, found = [], []
            for t in batch.column("t"):
                text = t.as_py()
                fps.append(simhash.fingerprint(text))
                found.append(keys(shingles(text)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(fps, pa.int64()), pa.array(found, pa.list_(pa.int64()))], out.names)

    return materialize(rows.select("key", "id", "t").mapInArrow(run, out).withColumn("n", F.monotonically_increasing_id()), "neardup-marks")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group: the one with the smallest id, a null id last.

    A group is what links of fingerprints join, and then, of one document of each of these groups, what similarity of
    five-word shingles joins. A document is an id and a text, so different texts that share an id are different documents;
    rows alike in both are one document, and the row that is least as JSON stays. Null and empty texts are alike. Columns of
    docs, whatever their names, are carried along.
    """
    workers_see_package(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("id"), docs[text].cast("string").alias("t"))
    rows = rows.withColumn("key", row_key(F.col("id"), F.col("t")))
    marks = _marks(rows)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key", "n")
    first = materialize(marks.groupBy("fp").agg(F.min(order).alias("first")), "neardup-fps")
    left = simhash.groups(first).groupBy("component").agg(F.min("first").alias("first")).select("first.n")
    left = materialize(marks.join(left, "n", "left_semi").select("n", "key", "id", "keys"), "neardup-left")
    near = connected_components(links(left.select("n", "key", "keys"), rows)).withColumnRenamed("id", "n")
    near = near.join(left.drop("keys"), "n").withColumn("order", order)
    lose = near.join(near.groupBy("component").agg(F.min("order").alias("first")).select("first.n"), "n", "left_anti").select("key")
    stay = left.select("key").join(lose, "key", "left_anti")
    gone = materialize(marks.select("key").distinct().join(stay, "key", "left_anti"), "neardup-gone")
    again = marks.groupBy("key").count().filter("count > 1").select("key")
    found = marked(rows.select("row", "key"), materialize(gone.union(again), "neardup-doubtful"))
    doubtful = found.filter("maybe").join(gone, "key", "left_anti").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return found.filter("not maybe").select("row.*").unionByName(doubtful.select("row.*"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(src, dst) links of five-word similarity alone, by document id. Ids must be distinct and not null."""
    rows = docs.select(docs[doc_id].alias("id"), docs[text].cast("string").alias("t")).withColumn("key", row_key(F.col("id"), F.col("t")))
    marks = _marks(rows)
    found = links(marks.select("n", "key", "keys"), rows)
    id_of = lambda c: marks.select(F.col("n").alias(c), F.col("id").alias(f"{c}_id"))
    return found.join(id_of("src"), "src").join(id_of("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
