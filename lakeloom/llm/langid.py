"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 lower-cased characters are hashed into FEATURES places; a feature is its share of a text's n-grams times
its inverse document frequency, which is counted over all documents that may be learnt from. Weights come from
follow-the-regularised-leader with elastic-net penalties on a bounded sample, so most are exactly zero; a temperature that is
fitted on a part of the sample kept apart makes the probabilities honest. A text's score is the mean of its n-grams' weights,
so a text of any length is one pass over its characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.sift import row_key
from lakeloom.runtime import materialize, workers_see_package

BITS, LONGEST = 15, 3
FEATURES = 1 << BITS
#: Odd multipliers, one per place in an n-gram and one per length.
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
#: The classifier is fitted on at most so many documents, shared equally by the languages, five of each at least.
SAMPLE = 2_400
#: More languages than this are an error: the model has a weight for each feature and language.
LANGUAGES = 1_000
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 4, 0.5, 1.0, 0.02, 0.001, 50.0
#: Characters in hand at a time.
PART = 1 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def features(text: str) -> Iterator[np.ndarray]:
    """The hashed n-grams of a text, repeats included, in parts."""
    text = f" {text.lower()} "
    for at in range(0, len(text), PART):
        c = np.frombuffer(text[at : at + PART + LONGEST - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        fresh = min(len(c), PART)  # n-grams that start here
        for n in range(1, LONGEST + 1):
            m = min(fresh, len(c) - n + 1)
            if m > 0:
                h = c[:m] * MIX[0] + MIX[3] * np.uint32(n)
                for k in range(1, n):
                    h = (h ^ (h >> np.uint32(15))) * MIX[k] + c[k : k + m]
                h = (h ^ (h >> np.uint32(13))) * MIX[1]
                yield (h >> np.uint32(32 - BITS)).astype(np.int64)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text is part modulo parts; rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and documents, over all rows of column t. A task returns one row per feature it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("t"):
                seen = np.zeros(FEATURES + 1, dtype=bool)
                for part in features(text.as_py()):
                    seen[part] = True
                seen[FEATURES] = True
                df += seen
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["f", "n"])

    rows = texts.select("t").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES + 1, dtype=np.int64)
    df[rows.column("f").to_numpy()] = rows.column("n").to_numpy()
    return df[:FEATURES], int(df[FEATURES])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # FEATURES x languages, with the idf multiplied in
    bias: np.ndarray
    temperature: float

    def scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for part in features(text):
            total += self.weights[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        return self.bias + total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        s = self.scores(text) / self.temperature
        p = np.exp(s - s.max())
        k = int(np.argmax(s))
        return self.languages[k], float(p[k] / p.sum())


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray) -> Model:
    """examples: distinct features, their shares, the number of the language. Every fifth sets the temperature."""
    k = len(languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rows = [(np.append(f, FEATURES), np.append(v * idf[f] * SCALE, 1.0), y) for f, v, y in examples]
    learn = [r for i, r in enumerate(rows) if i % 5 != 4]
    apart = rows[4::5]
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(learn)):
            at, x, y = learn[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / ALPHA * w
            n[at] = new
    w = weights(slice(None))
    scored = [(x @ w[at], y) for at, x, y in apart or rows]

    def loss(t: float) -> float:
        return sum(np.log(np.exp((s - s.max()) / t).sum()) + (s.max() - s[y]) / t for s, y in scored)

    steps = np.geomspace(0.25, 20, 45)
    t = float(min(steps, key=loss)) if scored else 1.0
    return Model(languages, (w[:FEATURES] * idf[:, None] * SCALE).astype(np.float32), w[FEATURES], t)


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """rows: key (the same for copies; its order is that of the sample), t, lang, all of them to learn from.

    Copies are one document of the sample, however many there are, so they can't crowd out others of their language.
    """
    keys = materialize(rows.select("lang", "key").distinct(), "lang-keys")
    found = keys.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counts = {r.lang: r["count"] for r in found}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((FEATURES, 0), dtype=np.float32), np.zeros(0), 1.0)
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    # A language's least keys. Keys are MD5 sums, so the first digits are a number in [0, 1), and only about four times as many
    # keys as wanted are below the bound and move.
    most = max(5, sample // len(languages))
    u = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / 2**52
    bounds = keys.sparkSession.createDataFrame([(k, min(1.0, 4 * most / n + 32 / n)) for k, n in counts.items()], "lang string, bound double")
    near = keys.withColumn("u", u).join(F.broadcast(bounds), "lang").filter(F.col("u") <= F.col("bound"))
    order = Window.partitionBy("lang").orderBy("key")
    picked = near.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= most).select("lang", "key")
    picked = materialize(picked, "lang-picked")  # at most sample rows, or five a language
    picked = rows.join(F.broadcast(picked), ["lang", "key"]).groupBy("lang", "key").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("t"):
                f, c = np.unique(np.concatenate(list(features(text.as_py()))), return_counts=True)
                found.append((f.astype(np.int32), (c / c.sum()).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float32()))], ["key", "lang", "f", "v"])

    # Bounded: sample rows of at most FEATURES numbers each.
    sparse = picked.select("key", "lang", "t").mapInArrow(run, "key string, lang string, f array<int>, v array<float>").toArrow().to_pylist()
    sparse.sort(key=lambda r: (r["key"], r["lang"]))
    number = {x: i for i, x in enumerate(languages)}
    return fit([(np.array(r["f"], dtype=np.int64), np.array(r["v"], dtype=np.float64), number[r["lang"]]) for r in sparse], languages, idf)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 3, part: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of docs.

    Learnt from rows that are not held out and have a text with words and a lang; null, empty and letterless texts are und
    with score 0, and so is everything if nothing can be learnt. Repeated rows give repeated results. Other columns are not
    carried along.
    """
    spark = docs.sparkSession
    workers_see_package(spark)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("t"), docs[lang].cast("string").alias("lang"), held_out(docs[doc_id], parts, part).alias("held_out"))
    key = row_key(F.col("doc_id"), F.col("t"))
    learn = rows.filter(~F.col("held_out") & F.col("lang").isNotNull() & (F.coalesce(F.length("t"), F.lit(0)) > 0)).select(key.alias("key"), "t", "lang")
    shared = spark.sparkContext.broadcast(train(learn, sample))
    here = rows.select("doc_id", "held_out", "t")
    out = T.StructType([here.schema["doc_id"], here.schema["held_out"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], out.names)

    return here.mapInArrow(run, out)


def op6(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
