"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

The terms are all words of the labelled examples, whichever label they have. A term's weight is its TF-IDF, with document
frequencies over all documents, times 1 + GAIN times the strength of its tie to the label in the sample (the root of
chi-square per document); without that factor, neighbours share a topic, not a tone. The examples are kept in an inverted
index, in blocks, with the largest weight of each term in each block. A text's best possible cosine in a block bounds that
block; blocks are read from the best bound down until the k-th best cosine found is above the next bound, so the neighbours
are exact. Neighbours vote with their closeness against a prior; a logistic curve fitted on votes of the examples about each
other makes a probability of it, and the nearest examples are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.runtime import materialize, workers_see_package

#: The classifier is fitted on at most so many labelled rows, half of them toxic if there are enough.
SAMPLE = 2_400
#: How much a tie to the label adds to a term's weight; chi-square up to NOISE counts as no tie (1 of 100 has more by chance).
GAIN, NOISE = 20.0, 6.6
NEIGHBOURS, BLOCK = 15, 64
#: Weight of the prior among the votes, as a part of one neighbour's, and the power of the cosine that a vote weighs.
PRIOR, POWER = 0.2, 2.0
EVIDENCE = 3
#: Words whose counts a task holds before it drops those that aren't terms.
HELD = 200_000
#: A term that more than one of so many examples has is kept as a full row of weights instead of postings.
COMMON = 8
WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> Counter:
    """The words of a text, lower-cased runs of letters, and how often they occur."""
    return Counter(WORD.findall(text.lower()))


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text is part modulo parts; rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


class Vocabulary:
    """The terms with their numbers; of() gives the numbers and counts of those in a text."""

    def __init__(self, names: list[str]):
        self.number = {t: i for i, t in enumerate(names)}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found, get = terms(text), self.number.get
        at = np.array(list(map(get, found, repeat(-1))), dtype=np.int64)
        known = at >= 0
        return at[known], np.array(list(found.values()), dtype=np.float64)[known]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and the lengths of the ranges."""
    n = ends - starts
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts, n), n


@dataclass
class Index:
    """Unit vectors of the examples as postings by term, cut into runs of one block of BLOCK examples; common terms as full rows."""

    ids: list
    labels: np.ndarray
    weight: np.ndarray  # of each term
    vectors: list[tuple[np.ndarray, np.ndarray]]
    prior: float
    slope: float = 4.0
    shift: float = 0.0

    def __post_init__(self):
        self.blocks = max(1, -(-len(self.ids) // BLOCK))
        row = np.repeat(np.arange(len(self.vectors)), [len(at) for at, _ in self.vectors])
        term = np.concatenate([at for at, _ in self.vectors] or [np.zeros(0, dtype=np.int64)])
        value = np.concatenate([w for _, w in self.vectors] or [np.zeros(0)])
        common = np.bincount(term, minlength=len(self.weight)) * COMMON > len(self.ids)
        self.full_row = np.where(common, np.cumsum(common) - 1, -1)
        here = common[term]
        self.full = np.zeros((int(common.sum()), self.blocks * BLOCK))
        self.full[self.full_row[term[here]], row[here]] = value[here]
        row, term, value = row[~here], term[~here], value[~here]
        order = np.lexsort((row, term))
        self.row, self.value, term = row[order].astype(np.int32), value[order], term[order]
        block = self.row // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, dtype=np.int64)
        self.entry = np.append(first, len(term))  # where the postings of a run begin
        self.block = block[first]
        self.most = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0)
        self.run = np.searchsorted(term[first], np.arange(len(self.weight) + 1))  # where the runs of a term begin
        self.vectors = []

    def unit(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return unit(self.weight, at, counts)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a cosine above 0, ties to the earlier example."""
        if not len(at):
            return []
        full = self.full_row[at]
        common = full >= 0
        full, strength = full[common], w[common]
        at, w = at[~common], w[~common]
        runs, n = _ranges(self.run[at], self.run[at + 1])
        w = np.repeat(w, n)
        block = self.block[runs]
        known = (strength @ self.full[full]).reshape(-1, BLOCK)
        bound = (np.bincount(block, w * self.most[runs], self.blocks) + known.max(axis=1)) * (1 + 1e-9)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found: list[tuple[float, int]] = []
        done = 0
        while done < len(order):
            # First the best few blocks, then all whose bound isn't below the k-th best cosine.
            reach = done + 8 if len(found) < k else int((bound[order] >= found[k - 1][0]).sum())
            if reach <= done:
                break
            now = np.sort(order[done:reach])
            asked = np.zeros(self.blocks, dtype=bool)
            asked[now] = True
            pick = asked[block]
            own = runs[pick]
            entries, n = _ranges(self.entry[own], self.entry[own + 1])
            cosine = np.bincount(self.row[entries], np.repeat(w[pick], n) * self.value[entries], self.blocks * BLOCK).reshape(-1, BLOCK)[now]
            cosine = (cosine + known[now]).ravel()
            rows = (now[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            if without >= 0:
                cosine[rows == without] = 0
            hits = np.flatnonzero(cosine > 0)
            if len(hits) > k:
                hits = hits[cosine[hits] >= np.partition(cosine[hits], -k)[-k]]
            found = sorted(found + [(float(cosine[h]), int(rows[h])) for h in hits], key=lambda x: (-x[0], x[1]))[:k]
            done = reach
        return found

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The toxic share of the neighbours by closeness, with a part of a neighbour that votes the share of toxic labels."""
        weight = [min(1.0, c) ** POWER for c, _ in near]
        if not weight or not sum(weight):
            return self.prior
        extra = PRIOR * sum(weight) / len(weight)
        return (sum(w * self.labels[i] for w, (_, i) in zip(weight, near, strict=True)) + extra * self.prior) / (sum(weight) + extra)

    def probability(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (vote - 0.5) + self.shift, -30, 30))))

    def calibrate(self, votes: np.ndarray) -> None:
        """Fits the curve to the votes that the others give each example (logistic regression by Newton's steps, with a small penalty)."""
        x = votes - 0.5
        y = self.labels.astype(np.float64)
        design, beta = np.stack([x, np.ones_like(x)], axis=1), np.array([4.0, 0.0])
        # The sample may hold more toxic rows than there are; weights undo that.
        share = y.mean()
        each = np.where(y > 0, self.prior / max(share, 1e-9), (1 - self.prior) / max(1 - share, 1e-9))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            slope = design.T @ (each * (y - p)) - 0.1 * (beta - np.array([4.0, 0.0]))
            bend = (design * (each * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
            step = np.linalg.solve(bend, slope)
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.shift = max(1.0, float(beta[0])), float(beta[1])


def unit(weight: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * weight[at]
    norm = np.sqrt((w * w).sum())
    return w / norm if norm > 0 else w


def term_weights(df: np.ndarray, n: int, yes: np.ndarray, all_: np.ndarray, n_yes: int, n_all: int) -> np.ndarray:
    """IDF (df of n documents) times the tie to the label: yes of n_yes toxic and all_ of n_all examples hold the term."""
    idf = np.log((1 + n) / (1 + df)) + 1.0
    n_no, no = n_all - n_yes, all_ - yes
    if not n_yes or not n_no:
        return idf
    cross = yes * (n_no - no) - no * (n_yes - yes)
    chi2 = cross * cross * float(n_all) / np.maximum(all_ * (n_all - all_) * float(n_yes) * n_no, 1e-9)
    return idf * (1 + GAIN * np.sqrt(np.maximum(0.0, chi2 - NOISE) / n_all))


def _frequencies(texts: DataFrame, names) -> tuple[np.ndarray, int]:
    """Documents with each term, and documents, over all rows of column t. names: the broadcast terms."""
    size = len(names.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, df, seen = {t: i for i, t in enumerate(names.value)}, np.zeros(size + 1, dtype=np.int64), Counter()

        def settle() -> None:
            for t, n in seen.items():
                if t in number:
                    df[number[t]] += n
            seen.clear()

        for batch in batches:
            for text in batch.column("t"):
                seen.update(set(WORD.findall(text.as_py().lower())))
                df[size] += 1
                if len(seen) > HELD:
                    settle()
        settle()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["f", "n"])

    rows = texts.mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, dtype=np.int64)
    df[rows.column("f").to_numpy()] = rows.column("n").to_numpy()
    return df[:size], int(df[size])


def train(docs: DataFrame, known: DataFrame, sample: int = SAMPLE):
    """(broadcast terms, Index). docs: doc_id, t (never null). known: doc_id, toxic (0 or 1), one row an id, all of them to learn from.

    The sample's ids are picked from the labels alone; only they, at most sample ids, meet the texts, and of an id with
    several texts only the least one is an example. The driver gets the words of the sample, whatever the number of documents.
    """
    spark = docs.sparkSession
    key = F.concat(F.md5(F.col("doc_id").cast("string")), F.col("doc_id").cast("string"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    yes = min(counts.get(1, 0), max(sample // 2, sample - counts.get(0, 0)))
    no = min(counts.get(0, 0), sample - yes)
    ids = None
    for toxic, most in ((1, yes), (0, no)):
        part = known.filter(F.col("toxic") == toxic).withColumn("key", key).orderBy("key").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    picked = docs.join(F.broadcast(ids), "doc_id").groupBy("key", "doc_id", "toxic").agg(F.min("t").alias("t"))
    picked = materialize(picked, "toxic-sample")
    prior = counts.get(1, 0) / max(1, sum(counts.values()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py()) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), batch.column("toxic"), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["key", "doc_id", "toxic", "words", "counts"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    rows = picked.select("key", "doc_id", "toxic", "t").mapInArrow(words, f"key string, doc_id {kind}, toxic int, words array<string>, counts array<int>").toArrow()
    rows = rows.take(pc.sort_indices(rows.column("key")))
    size = pc.list_value_length(rows.column("words")).to_numpy()
    ends = np.cumsum(size)
    said = pc.list_flatten(rows.column("words")).combine_chunks().dictionary_encode()
    # Terms in the order of their text, so that reruns agree.
    order = pc.sort_indices(said.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    names = said.dictionary.take(pa.array(order)).to_pylist()
    term = place[said.indices.to_numpy()] if len(said) else np.zeros(0, dtype=np.int64)
    times = pc.list_flatten(rows.column("counts")).to_numpy().astype(np.float64)
    labels = rows.column("toxic").to_numpy().astype(np.int64)
    shared = spark.sparkContext.broadcast(names)
    df, n = _frequencies(docs.select("t"), shared)
    toxic = np.repeat(labels, size) == 1
    in_all, in_yes = np.bincount(term, minlength=len(names)), np.bincount(term[toxic], minlength=len(names))
    weight = term_weights(df.astype(np.float64), n, in_yes.astype(np.float64), in_all.astype(np.float64), int(labels.sum()), len(labels))
    vectors, main = [], []
    for lo, hi in zip(ends - size, ends, strict=True):
        at, c = term[lo:hi], times[lo:hi]
        turn = np.argsort(at)
        at, c = at[turn], c[turn]
        vectors.append((at, unit(weight, at, c)))
        main.append(int(at[np.argmax(c)]) if len(at) else -1)
    # Examples with the same main word share blocks, which keeps the bounds low.
    keys, doc_ids = rows.column("key").to_pylist(), rows.column("doc_id").to_pylist()
    turn = sorted(range(len(keys)), key=lambda i: (main[i], labels[i], keys[i]))
    index = Index([doc_ids[i] for i in turn], labels[turn], weight, [vectors[i] for i in turn], prior)
    if names:
        place_of = {keys[i]: k for k, i in enumerate(turn)}
        index.calibrate(_votes(picked, shared, index, place_of))
    return shared, index


def _votes(picked: DataFrame, names, index: Index, place_of: dict[str, int]) -> np.ndarray:
    """What the others vote about each example, in the order of the index; the searches run on the executors."""
    shared = picked.sparkSession.sparkContext.broadcast((index, place_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, place), vocabulary = shared.value, Vocabulary(names.value)
        for batch in batches:
            at = [place[k] for k in batch.column("key").to_pylist()]
            votes = []
            for i, text in zip(at, batch.column("t"), strict=True):
                t, c = vocabulary.of(text.as_py())
                votes.append(own.vote(own.nearest(t, own.unit(t, c), without=i)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(votes, pa.float64())], ["i", "vote"])

    rows = picked.select("key", "t").repartition(picked.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "i long, vote double").toArrow()
    votes = np.zeros(len(index.ids))
    votes[rows.column("i").to_numpy()] = rows.column("vote").to_numpy()
    shared.unpersist()
    return votes


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples) per row of docs.

    A null text is an empty one. A text without a word of the examples has no neighbours: its score is that of the prior.
    If nothing can be learnt, the score is the share of toxic labels, 0 without labels. Labels that are null or of rows that
    are held out are never read; an id with several labels has the largest. Repeated rows give repeated results. Other columns
    are not carried along.
    """
    spark = docs.sparkSession
    workers_see_package(spark)
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"), held_out(docs[doc_id]).alias("held_out"))
    known = labels.select(labels[doc_id].alias("doc_id"), labels[label].cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    names, index = train(rows, materialize(known, "toxic-labels"), sample)
    index.prior = index.prior if len(index.ids) else 0.0
    learnt = bool(names.value)
    shared = spark.sparkContext.broadcast(index)
    here = rows.select("doc_id", "held_out", "t")
    kind = here.schema["doc_id"]
    out = T.StructType([kind, here.schema["held_out"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(kind.dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vocabulary = shared.value, Vocabulary(names.value)
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column("t"):
                at, counts = vocabulary.of(text.as_py())
                near = own.nearest(at, own.unit(at, counts)) if len(at) else []
                scores.append(own.probability(own.vote(near)) if learnt else own.prior)
                evidence.append([own.ids[i] for _, i in near[:EVIDENCE]])
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(evidence, pa.list_(batch.schema.field("doc_id").type))], out.names)

    return here.mapInArrow(run, out)


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels)
