"""Transcripts: choice, assembly, chunks, time marks, embeddings, nearest chunks, diversity, prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import text as tx
from lakeloom.operators.relational import asof
from lakeloom.runtime import materialize, workers_see_package

#: Where a text is cut, best first; the empty string cuts anywhere.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "। ", "? ", "! ", ". ", "; ", ", ", " ", ""]
CHUNK_SIZE, CHUNK_OVERLAP, TOP_K, MOST_TURNS = 800, 150, 4, 4
MMR_LAMBDA = 0.5
#: Vectors in a block, and queries that meet it at a time.
VECTOR_BLOCK, QUERY_BLOCK = 65_536, 256
NOT_FOUND = "The transcript does not say."
CONDENSE = "Rewrite the last question so that it can be read without the conversation.\n\nConversation:\n%s\n\nQuestion: %s\nRewritten question:"
ANSWER = "Answer from the excerpts only, and name their time marks. If they do not hold the answer, say: %s\n\nExcerpts:\n%s\n\nConversation:\n%s\n\nQuestion: %s\nAnswer:"


def select_transcript(candidates: DataFrame, preferred: list[str], target: str | None = "en", keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """One candidate per video, with translate_to.

    candidates: keys, pos (their order), language_code, is_generated, is_translatable, translations (array of codes). The
    first preferred language that any candidate has wins, made by hand before generated, earlier before later. Without one,
    the best of all is taken, translated to target if that is offered, else as it is.
    """
    wanted = F.array(*[F.lit(p) for p in preferred]).cast("array<string>")
    rank = F.array_min(F.transform(wanted, lambda p, i: F.when(tx.same_language(F.col("language_code"), p), i)))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("rank"), "is_generated", "pos")
    best = candidates.withColumn("rank", rank).withColumn("place", F.row_number().over(order)).filter("place = 1")
    offered = F.exists("translations", lambda c: F.lower(c) == F.lower(F.lit(target))) if target else F.lit(False)
    translate = F.when(F.col("rank").isNull() & F.coalesce(F.col("is_translatable"), F.lit(False)) & F.coalesce(offered, F.lit(False)), F.lit(target))
    return best.withColumn("translate_to", translate).drop("rank", "place")


def offsets(segments: DataFrame, keys: list[str], clean: Callable[[Column], Column] = tx.clean_text) -> DataFrame:
    """keys, seg, text, start, pos: cleaned segments that aren't empty, and where each begins in the joined text."""
    rows = segments.withColumn("text", clean(F.col("text"))).filter(F.col("text") != "")
    before = Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("pos", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))


def assemble(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, last_pos: the cleaned segments of offsets() joined by one blank, in order, and where the last one begins."""
    ordered = F.array_sort(F.collect_list(F.struct("seg", "text")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.max("pos").alias("last_pos"))


def _pieces(text: str, separators: list[str]) -> tuple[list[str], list[str]]:
    """The text cut after its first separator that occurs, and the separators that are finer."""
    for i, sep in enumerate(separators):
        if sep == "":
            return list(text), []
        if sep in text:
            parts = text.split(sep)
            return [p for p in [*(x + sep for x in parts[:-1]), parts[-1]] if p], separators[i + 1 :]
    return [text], []


def _merge(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Pieces joined up to size; each chunk begins with the last pieces of the one before, up to overlap."""
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            yield "".join(held).strip()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if held:
        yield "".join(held).strip()


def _cut(text: str, separators: list[str], size: int, overlap: int) -> Iterator[str]:
    pieces, finer = _pieces(text, separators)
    short: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        yield from _merge(short, size, overlap)
        short = []
        if finer:
            yield from _cut(piece, finer, size, overlap)
        else:
            yield piece.strip()
    yield from _merge(short, size, overlap)


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, str]]:
    """(start, chunk): chunks of at most size characters, without outer blanks; start is found from where the last one could end."""
    if overlap >= size:
        raise ValueError("overlap must be below size")
    out: list[tuple[int, str]] = []
    start, length = 0, 0
    for chunk in _cut(text, SEPARATORS, size, overlap):
        if not chunk:
            continue
        start = text.find(chunk, max(0, start + length - overlap if out else 0))
        out.append((max(0, start), chunk))
        start, length = max(0, start), len(chunk)
    return out


def chunks(texts: DataFrame, keys: list[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """keys, chunk_id, start_index, text of texts(keys, text). A text is one row, so rows split apart from each other; null and blank texts have no chunks."""
    rows = texts.select(*keys, F.col("text").cast("string").alias("text"))
    workers_see_package(texts.sparkSession)
    added = [T.StructField("chunk_id", T.LongType()), T.StructField("start_index", T.LongType()), T.StructField("text", T.StringType())]
    out = T.StructType([*[f for f in rows.schema.fields if f.name != "text"], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, k, *c) for i, t in enumerate(batch.column("text").to_pylist()) for k, c in enumerate(split_text(t or "", size, overlap))]
            row, k, start, text = zip(*found, strict=True) if found else ((), (), (), ())
            kept = [batch.column(c).take(pa.array(row, pa.int64())) for c in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(k, pa.int64()), pa.array(start, pa.int64()), pa.array(text, pa.string())], out.names)

    return rows.mapInArrow(run, out)


def time_chunks(pieces: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """pieces with start_seconds, timestamp: the segment that a chunk begins in. marks: keys, pos, start."""
    found = asof(pieces.withColumnRenamed("start_index", "pos"), marks.select(*keys, "pos", "start"), keys, "pos", "start")
    return found.withColumnRenamed("pos", "start_index").withColumnRenamed("start", "start_seconds").withColumn("timestamp", tx.timestamp(F.col("start_seconds")))


def hashing_embedding(texts: list[str], dims: int = 64) -> np.ndarray:
    """Unit vectors of hashed words: a stand-in for a model, the same everywhere."""
    from zlib import crc32

    out = np.zeros((len(texts), dims), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = crc32(w.encode())
            out[i, h % dims] += 1.0 if h & 0x10000 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed(df: DataFrame, text: str = "text", model: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashing_embedding) -> DataFrame:
    """df with embedding array<float>. model() is called once a task and gives the function from texts to vectors."""

    workers_see_package(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model()
        for s in batches:
            yield pd.Series(list(of(s.fillna("").tolist())), index=s.index)

    return df.withColumn("embedding", run(F.col(text)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, similarity): the k most similar by cosine to 9 digits, exact, ties to smaller ids. queries: query_id, vector; a stated set.

    A block of vectors is one task's work: they move once, and the queries pass by in batches, scored as a product of
    matrices. Each block returns its k best for each query, and only those meet in the last ranking.
    """
    workers_see_package(vectors.sparkSession)
    unit = materialize(vectors.select(F.col(vec_id).alias("vec_id"), tx.l2_normalised(F.col(embedding)).alias("v")), "vectors")
    blocks = max(1, -(-unit.count() // VECTOR_BLOCK))
    ids, asks = unit.schema["vec_id"].dataType, queries.schema["query_id"].dataType
    dealt = unit.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(None).cast(asks).alias("query_id"), "vec_id", "v", F.lit(False).alias("asks"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "query_id", F.lit(None).cast(ids).alias("vec_id"), tx.l2_normalised(F.col("vector")).alias("v"), F.lit(True).alias("asks"))
    out = T.StructType([T.StructField("query_id", asks), T.StructField("vec_id", ids), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, names, held = None, None, [], []
        for batch in batches:
            place, kind = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(place)), np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1):
                if not len(part):
                    continue
                if place[part[0]] != now:
                    now, whole, names, held = place[part[0]], None, [], []
                rows = batch.slice(part[0], len(part))
                if not kind[part[0]]:
                    names += rows.column("vec_id").to_pylist()
                    held.append(np.stack([np.array(x, dtype=np.float64) for x in rows.column("v").to_pylist()]))
                    continue
                if whole is None:
                    whole = np.concatenate(held) if held else np.zeros((0, 0))
                found = []
                for i in range(0, len(part), QUERY_BLOCK) if len(whole) else ():
                    piece = rows.slice(i, QUERY_BLOCK)
                    similar = np.round(np.stack([np.array(x, dtype=np.float64) for x in piece.column("v").to_pylist()]) @ whole.T, 9)
                    for q, row in zip(piece.column("query_id").to_pylist(), similar, strict=True):
                        least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                        best = np.flatnonzero(row >= least)  # in the order of ids
                        best = best[np.argsort(-row[best], kind="stable")[:k]]
                        found += [(q, names[j], float(row[j])) for j in best]
                types = [batch.schema.field("query_id").type, batch.schema.field("vec_id").type, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], out.names)

    scored = dealt.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks", "vec_id").mapInArrow(run, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def fetch_size(k: int) -> int:
    return max(20, 5 * k)


def diverse(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, lam: float = MMR_LAMBDA, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, pick, vec_id): of the fetch_size(k) nearest, first the most similar, then each time the one with the best lam * similarity - (1 - lam) * greatest similarity to those picked."""
    near = nearest(vectors, queries, fetch_size(k), vec_id, embedding).join(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")), "vec_id")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        v = np.stack(rows["v"].to_numpy())
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(norm > 0, norm, 1)
        sims, chosen, worst = rows["similarity"].to_numpy(), [], np.full(len(rows), -np.inf)
        while len(chosen) < min(k, len(rows)):
            score = sims if not chosen else lam * sims - (1 - lam) * worst
            best = max((i for i in range(len(rows)) if i not in chosen), key=lambda i: (round(float(score[i]), 12), -i))
            chosen.append(best)
            worst = np.maximum(worst, v @ v[best])
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "pick": range(1, len(chosen) + 1), "vec_id": rows["vec_id"].iloc[chosen].to_numpy()})

    workers_see_package(vectors.sparkSession)
    kind = queries.schema["query_id"].dataType.simpleString()
    return near.groupBy("query_id").applyInPandas(pick, f"query_id {kind}, pick int, vec_id {vectors.schema[vec_id].dataType.simpleString()}")


def _joined(df: DataFrame, keys: list[str], order: list[str], line: Column, sep: str, name: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["line"]), sep).alias(name))


def context(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, context: [time mark] text, in order of time, a blank line between. docs: keys, start_seconds, chunk_id, text."""
    line = F.concat(F.lit("["), tx.timestamp(F.col("start_seconds")), F.lit("] "), F.col("text"))
    return _joined(docs, keys, ["start_seconds", "chunk_id"], line, "\n\n", "context")


def history(turns: DataFrame, keys: list[str], most: int = MOST_TURNS) -> DataFrame:
    """keys, history: the last pairs of a question and its answer, in order, two lines each. turns: keys, turn, role, text.

    A pair is a user's row and the assistant's rows up to the user's next. Questions without an answer, what is said before
    the first question and other roles' rows are left out.
    """
    so_far = Window.partitionBy(*keys).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.filter(F.col("role").isin("user", "assistant")).withColumn("__pair", F.count_if(F.col("role") == "user").over(so_far))
    pairs = rows.filter("__pair > 0").groupBy(*keys, "__pair").agg(F.bool_or(F.col("role") == "assistant").alias("__answered")).filter("__answered")
    newest = Window.partitionBy(*keys).orderBy(F.desc("__pair"))
    pairs = pairs.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= most).select(*keys, "__pair")
    return _joined(rows.join(pairs, [*keys, "__pair"]), keys, ["turn"], F.concat_ws(": ", F.initcap("role"), F.col("text")), "\n", "history")


def standalone(df: DataFrame, rewrite: Callable[[Column], Column]) -> DataFrame:
    """df(question, history) with standalone: rewritten by a model only where there is a history."""
    asked = F.format_string(CONDENSE, F.col("history"), F.col("question"))
    return df.withColumn("standalone", F.when(F.trim(F.coalesce("history", F.lit(""))) != "", tx.clean_question(rewrite(asked))).otherwise(F.col("question")))


def prompt(df: DataFrame) -> DataFrame:
    """df(standalone, history, context) with prompt."""
    return df.withColumn("prompt", F.format_string(ANSWER, F.lit(NOT_FOUND), F.col("context"), F.coalesce("history", F.lit("")), F.col("standalone")))
