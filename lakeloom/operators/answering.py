"""From a video to an index, and from questions to answers with their sources."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import text as tx
from lakeloom.operators import retrieval as rt
from lakeloom.runtime import materialize
from lakeloom.sources import reports
from lakeloom.sources.settings import Settings

VIDEO = ["video_id"]


class Transcripts(Protocol):
    """Where transcripts come from; fetching is the caller's."""

    def candidates(self, video_id: str) -> DataFrame:
        """One row per transcript on offer, as select_transcript() takes them."""

    def segments(self, chosen: Row) -> DataFrame:
        """video_id, seg, text, start of the chosen one, translated if chosen.translate_to says so."""


@dataclass(frozen=True)
class VideoMeta:
    video_id: str
    language_code: str
    is_generated: bool
    translated: bool
    num_chunks: int


@dataclass(frozen=True)
class VideoIndex:
    """vectors: video_id, chunk_id, start_index, text, start_seconds, timestamp, url, embedding."""

    meta: VideoMeta
    vectors: DataFrame
    from_cache: bool = False


def index_path(video_id: str, settings: Settings) -> str:
    """A folder of its own for each video and each choice of settings that an index depends on."""
    digest = hashlib.sha1("|".join(settings.fingerprint_parts()).encode()).hexdigest()[:10]
    return f"{settings.cache_dir}/{video_id}-{digest}"


def save_index(index: VideoIndex, path: str) -> None:
    """Vectors as Parquet in a folder of their own, then the description that names it: one with a description is whole, and who reads an older one still can."""
    data = f"vectors-{uuid.uuid4().hex}"
    index.vectors.write.parquet(f"{path}/{data}")
    reports.sidecar(index.vectors.sparkSession, asdict(index.meta) | {"data": data}, f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> VideoIndex | None:
    """The index that was saved there; None if it is missing, broken or not as long as its description says."""
    try:
        said = json.loads(spark.read.text(f"{path}/meta").first().value)
        vectors = spark.read.parquet(f"{path}/{said.pop('data')}")
        meta = VideoMeta(**said)
        return VideoIndex(meta, vectors, True) if vectors.count() == meta.num_chunks else None
    except (PySparkException, ValueError, TypeError, KeyError, AttributeError):
        return None


def ingest(spark: SparkSession, link: str, settings: Settings, source: Transcripts, model=lambda: rt.hashing_embedding, use_cache: bool = True) -> VideoIndex:
    """The index of a video: the cached one if it can be read, else built and, if possible, cached.

    ValueError for a link without a video id, a video without a transcript, or a transcript without text.
    """
    video_id = spark.range(1).select(tx.video_id(F.lit(link))).first()[0]
    if video_id is None:
        raise ValueError(f"no video id in {link!r}")
    path = index_path(video_id, settings)
    cached = load_index(spark, path) if use_cache else None
    if cached:
        return cached
    chosen = rt.select_transcript(source.candidates(video_id), list(settings.preferred_languages), settings.target_language or None).first()
    if chosen is None:
        raise ValueError(f"no transcript of {video_id}")
    marks = rt.offsets(source.segments(chosen), VIDEO)
    pieces = rt.chunks(rt.assemble(marks, VIDEO), VIDEO, settings.chunk_size, settings.chunk_overlap)
    timed = rt.time_chunks(pieces, marks, VIDEO).withColumn("url", tx.timestamp_url(F.col("video_id"), F.col("start_seconds")))
    vectors = materialize(rt.embed(timed, model=model), "index")
    n = vectors.count()
    if not n:
        raise ValueError(f"the transcript of {video_id} has no text")
    index = VideoIndex(VideoMeta(video_id, chosen.language_code, chosen.is_generated, chosen.translate_to is not None, n), vectors)
    if use_cache:
        try:
            save_index(index, path)
        except PySparkException:  # the cache is a help, not a need
            pass
    return index


def retriever(index: VideoIndex, k: int = rt.TOP_K, model=lambda: rt.hashing_embedding, lam: float = rt.MMR_LAMBDA) -> Callable[[DataFrame], DataFrame]:
    """From (question_id, standalone) to (question_id, chunk_id, start_seconds, text, ...): near and diverse chunks."""

    def retrieve(asked: DataFrame) -> DataFrame:
        queries = rt.embed(asked, "standalone", model).select(F.col("question_id").alias("query_id"), F.col("embedding").alias("vector"))
        picked = rt.diverse(index.vectors, queries, k, lam, "chunk_id")
        return picked.select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("chunk_id")).join(index.vectors.drop("embedding"), "chunk_id")

    return retrieve


def answer(asked: DataFrame, retrieve: Callable[[DataFrame], DataFrame], generate: Callable[[Column], Column], rewrite: Callable[[Column], Column] | None = None) -> DataFrame:
    """question_id, question, standalone, sources (array of structs in order of time), answer. asked: question_id, question, history.

    generate and rewrite give a model's text for a column of prompts. Questions are rewritten only where there is a history.
    """
    alone = materialize(rt.standalone(asked, rewrite or generate), "questions")
    found = materialize(retrieve(alone.select("question_id", "standalone")), "sources")
    extra = [c for c in found.columns if c not in ("question_id", "start_seconds", "chunk_id")]
    sources = found.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("start_seconds", "chunk_id", *extra))).alias("sources"))
    rows = alone.join(sources, "question_id", "left").join(rt.context(found, ["question_id"]), "question_id", "left")
    rows = rt.prompt(rows.withColumn("context", F.coalesce("context", F.lit(""))))
    return rows.withColumn("answer", F.trim(generate(F.col("prompt")))).select("question_id", "question", "standalone", "sources", "answer")


@dataclass
class Chat:
    """One conversation: asks with the last turns as history, and keeps what was said."""

    spark: SparkSession
    retrieve: Callable[[DataFrame], DataFrame]
    generate: Callable[[Column], Column]
    rewrite: Callable[[Column], Column] | None = None
    most: int = rt.MOST_TURNS
    said: list[tuple[str, str]] = field(default_factory=list)

    def ask(self, question: str | None) -> Row:
        """The row of answer(). ValueError for a blank question."""
        question = (question or "").strip()
        if not question:
            raise ValueError("a question must not be blank")
        turns = [(0, 2 * i + k, role, text) for i, pair in enumerate(self.said) for k, (role, text) in enumerate(zip(("user", "assistant"), pair, strict=True))]
        kept = rt.history(self.spark.createDataFrame(turns, "question_id int, turn int, role string, text string"), ["question_id"], self.most).first()
        asked = self.spark.createDataFrame([(0, question, kept.history if kept else "")], "question_id int, question string, history string")
        found = answer(asked, self.retrieve, self.generate, self.rewrite).first()
        self.said.append((question, found.answer))
        return found

    def reset(self) -> None:
        self.said.clear()
