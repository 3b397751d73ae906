"""Token counts by the whole-token shortcut.

Before any text is read, each string of the vocabulary is given to the library by itself; those that come back as one token
are proven whole. A match of the pattern that is a whole token counts as one; only the others are merged, by the library,
and what a chunk of text counts is remembered by the worker within a bound.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.bpe import MORE, REMEMBERED, REMEMBERED_CHARS, Chunks, Matches, _pattern, _vocabulary, byte_characters
from lakeloom.llm.text import AGREED
from lakeloom.runtime import workers_see_package

#: A text is over the limit from one token more on.
LIMIT = 1024

class Counter(Matches):
    """Counts tokens as the library does by a vocabulary in its JSON form."""

    def __init__(self, data: bytes, pattern: str):
        from tokenizers import Tokenizer

        self.whole_library = Tokenizer.from_str(data.decode())
        self.whole_library.no_truncation()
        self.whole_library.no_padding()
        spec = json.loads(data)
        splitter = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and splitter.get("type") == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"]
        added = spec["added_tokens"]
        #: The shortcut holds for byte-level BPE by the pattern, without normalisation; other files go to the library whole.
        self.short = plain and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        vocabulary = spec["model"]["vocab"]
        super().__init__(self.whole_library.model, vocabulary.get(byte_characters()[0], -1), pattern)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.whole: set[str] = set()
        if self.short:
            byte_of = {c: b for b, c in enumerate(byte_characters())}
            strings = []
            for token in vocabulary:
                try:
                    strings.append(bytes(byte_of[c] for c in token).decode())
                except (KeyError, UnicodeDecodeError):  # a special token, or part of a character
                    continue
            for s, found in zip(strings, self.whole_library.encode_batch_fast(strings, add_special_tokens=False), strict=True):
                if len(found.ids) == 1 and self.pattern.fullmatch(s) and not (self.special and self.special.search(s)):
                    self.whole.add(s)
        self.chunks = Chunks(self._counts, MORE * REMEMBERED, MORE * REMEMBERED_CHARS)

    def _counts(self, chunks: list[str]) -> list[int]:
        whole = self.whole
        rows = [[m for m in self.pattern.findall(c)] for c in chunks]
        rest = list({m for row in rows for m in row if m not in whole})
        more = {m: len(ids) for m, ids in zip(rest, self.library_ids(rest), strict=True)}
        return [sum(1 if m in whole else more[m] for m in row) for row in rows]

    def count(self, text: str) -> int:
        if not self.short or not AGREED.fullmatch(text):
            return len(self.whole_library.encode(text, add_special_tokens=False).ids)
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return sum(sum(self.chunks.values(p)) for p in parts) + len(parts) - 1
        return sum(self.chunks.values(text))


_COUNTERS: dict[str, Counter] = {}


def counter(data: bytes, pattern: str) -> Counter:
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(data, pattern)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, pattern: str | None = None) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens, over_limit per row of docs.

    A null text is an empty one: 0 and 0. Texts of any length are counted whole. Special strings inside a text count as the
    library has them by default: one token each. Repeated rows give repeated results, an empty table an empty one; other
    columns of docs are not carried along, so their names don't matter.
    """
    spark, pattern = docs.sparkSession, pattern or _pattern()
    workers_see_package(spark)
    shared = _vocabulary(spark, path)
    here = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    here = here.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), "t")
    out = T.StructType([here.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shared.value, pattern)
        for batch in batches:
            found = [own.count(t.as_py()) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())], out.names)

    return here.mapInArrow(run, out).withColumn("over_limit", F.col("n_tokens") > limit)


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
