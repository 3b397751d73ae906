"""Byte-level BPE: encoding and decoding with the tokenizers library over Arrow batches.

A text is cut by a pattern; each match is encoded separately. The library is given the same vocabulary in its own terms:
every byte has a character, a token is a string of those, and each way to put a token together from two others is a merge,
in the order of ranks. Natural text repeats its words, so each distinct chunk (a word with the space before it) is encoded once
and remembered by the worker, within a bound. Decoding turns ids into the characters of their tokens, and these back into bytes
by the reversed byte table; a character whose bytes lie in several tokens comes out whole, as the bytes are joined before they
are read as UTF-8. Texts with characters that tiktoken's splitter classes by an older Unicode version are encoded by tiktoken.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakeloom.llm.text import AGREED
from lakeloom.runtime import workers_see_package

#: A worker remembers at most so many distinct chunks, and so many characters of them.
REMEMBERED, REMEMBERED_CHARS = 120_000, 2_500_000
#: So many times as much where ids don't leave the worker, which leaves more of its memory.
MORE = 4


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, else the next unused one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class Generations:
    """Remembered values, young and old. What is asked for again becomes young; what stays old is forgotten at the next age()."""

    def __init__(self):
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.chars = 0

    def age(self) -> None:
        self.old, self.young, self.chars = self.young, {}, 0

    def learn(self, keys, meaning) -> None:
        """All keys are young on return; meaning(list) gives the values of those that aren't remembered."""
        young, old = self.young, self.old
        missing = [k for k in set(keys) if k not in young]
        new = []
        for k in missing:
            if k in old:
                young[k] = old[k]
            else:
                new.append(k)
        young.update(zip(new, meaning(new), strict=True))
        self.chars += sum(map(len, missing))


class Chunks:
    """Cuts texts into chunks, each a run of white space and the run of other characters after it.

    No match of the pattern holds white space after another character, so chunks can be tokenised apart, and what is known
    of a chunk is remembered. meaning(chunks) gives the values of chunks that are new; they must all be tokenised alone.
    """

    def __init__(self, meaning, most: int = REMEMBERED, most_chars: int = REMEMBERED_CHARS):
        self.meaning, self.most, self.most_chars = meaning, most, most_chars
        self.forget()

    def forget(self) -> None:
        self.after_space = Generations()  # by the chunk without its first space
        self.other = Generations()

    def _values(self, units: list[str], known: Generations, space: str) -> list:
        try:
            return list(map(known.young.__getitem__, units))
        except KeyError:
            if len(self.after_space.young) + len(self.other.young) > self.most // 2 or self.after_space.chars + self.other.chars > self.most_chars // 2:
                self.after_space.age()
                self.other.age()
            known.learn(units, lambda new: self.meaning([u if u[:1] == "\n" else space + u for u in new] if space else new))
            return list(map(known.young.__getitem__, units))

    def values(self, text: str) -> list:
        """The values of a text's chunks in order."""
        if not text:
            return []
        if text[0] in WHITE or text[-1] in WHITE or any(x in text for x in RUNS):
            return self._values(CHUNK.findall(text), self.other, "")
        units = text.replace("\n", " \n").split(" ")
        return self._values(units[:1], self.other, "") + self._values(units[1:], self.after_space, " ")


#: White space as the pattern has it (the Unicode property). CHUNK holds for any text; without RUNS, chunks start at a lone space or line feed.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
RUNS = ("  ", " \n", "\n ", "\n\n", *(c for c in WHITE if c not in " \n"))
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


#: Stands between matches in one call of the library.
NUL = "\0"


class Matches:
    """The ids of matches of a pattern by a byte-level BPE model of the tokenizers library."""

    def __init__(self, model, nul: int, pattern: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer(model)
        cut = pre_tokenizers.Split(NUL, "isolated")
        self.library.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.nul = nul
        self.uncut = None
        self.pattern = regex.compile(pattern)

    def library_ids(self, matches: list[str]) -> list[tuple[int, ...]]:
        """The ids of each match. Those without NUL go to the library in one string, with NUL between them."""
        plain = [m for m in matches if NUL not in m]
        found, own = [], []
        for i in self.library.encode(NUL.join([*plain, ""]), add_special_tokens=False).ids:
            if i == self.nul:
                found.append(tuple(own))
                own = []
            else:
                own.append(i)
        found = dict(zip(plain, found, strict=True))
        return [found[m] if m in found else tuple(self._with_nul(m)) for m in matches]

    def _with_nul(self, match: str) -> list[int]:
        """A match that holds NUL, by a second library object that doesn't cut there."""
        if self.uncut is None:
            from tokenizers import Tokenizer, pre_tokenizers

            self.uncut = Tokenizer(self.library.model)
            self.uncut.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return self.uncut.encode(match, add_special_tokens=False).ids


class Codec(Matches):
    """One vocabulary of ranks."""

    def __init__(self, data: bytes, pattern: str, times: int = 1):
        from tokenizers import models

        ranks = read_ranks(data)
        self.ranks, self.decimal = ranks, {rank: str(rank) for rank in ranks.values()}
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        said = {token: "".join(chars[b] for b in token) for token in ranks}
        #: The byte table reversed: an id's token is characters, each of them one byte.
        self.bytes_of = {rank: bytes(byte_of[c] for c in said[token]) for token, rank in ranks.items()}
        merges = [(said[token[:i]], said[token[i:]]) for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        # A match that is a token as a whole is that token, whatever its merges.
        model = models.BPE(vocab={said[token]: rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True)
        super().__init__(model, ranks[NUL.encode()], pattern)
        self.matches = Generations()
        #: Chunks are remembered only for the pattern that is known to allow it.
        self.most, self.most_chars = REMEMBERED * times, REMEMBERED_CHARS * times
        self.chunks = Chunks(self._encode, self.most, self.most_chars) if pattern == _pattern() else None
        self.tiktoken = None

    def _encode(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """The ids of each chunk: its matches are encoded by the library, each distinct one once."""
        rows = [self.pattern.findall(c) for c in chunks]
        if len(self.matches.young) > self.most // 4 or self.matches.chars > self.most_chars // 4:
            self.matches.age()
        self.matches.learn((m for row in rows for m in row), self.library_ids)
        ids = self.matches.young
        return [ids[row[0]] if len(row) == 1 else tuple(i for m in row for i in ids[m]) for row in rows]

    def forget(self) -> None:
        """Drops what is remembered, so that an idle worker holds the vocabulary only."""
        self.matches = Generations()
        if self.chunks:
            self.chunks.forget()

    def ids(self, text: str) -> list[int]:
        if not AGREED.fullmatch(text):
            return self._tiktoken().encode_ordinary(text)
        return list(chain.from_iterable(self.chunks.values(text) if self.chunks else self._encode([text])))

    def _tiktoken(self):
        if self.tiktoken is None:
            import tiktoken

            self.tiktoken = tiktoken.Encoding("own", pat_str=self.pattern.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self.tiktoken

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """For each id, the characters [start, end) that hold at least one of its bytes. Tokens may share a character."""
        spans, at = [], 0
        starts = [i for i, c in enumerate(text) for _ in c.encode()]  # the character of each byte
        for i in self.ids(text):
            n = len(self.bytes_of[i])
            spans.append((starts[at], starts[at + n - 1] + 1))
            at += n
        return spans

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """Bytes that aren't UTF-8, as where ids were cut inside a character, become U+FFFD."""
        return self.decode_bytes(ids).decode(errors="replace")


_CODECS: dict[str, Codec] = {}


def codec(data: bytes, pattern: str, times: int = 1) -> Codec:
    """One codec a worker for each vocabulary; it lives as long as the worker."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest() + str(times)
    if key not in _CODECS:
        _CODECS[key] = Codec(data, pattern, times)
    return _CODECS[key]


def _vocabulary(spark: SparkSession, path: str):
    """The file's bytes, read by the driver and broadcast: about a megabyte, whatever the input."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, text: str = "text", pattern: str | None = None, with_offsets: bool = False) -> DataFrame:
    """docs plus ids array<int>, n_tokens long and, if asked for, starts and ends array<int> of the characters of each id.

    A null text is an empty one: no ids. Texts of any length are encoded whole. Columns of docs with those names are
    replaced. Rows stay apart, so repeated rows give repeated results, and an empty table gives an empty one.
    """
    spark, pattern = docs.sparkSession, pattern or _pattern()
    workers_see_package(spark)
    shared = _vocabulary(spark, path)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    if with_offsets:
        added += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("starts", "ends")]
    names = {f.name for f in added}
    own_text = next(n for n in ("text_" + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    here = docs.withColumn(own_text, docs[text].cast("string")).drop(*names)
    fields = [f for f in here.schema.fields if f.name != own_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for whole in batches:
            for batch in _slices(whole, own_text):
                texts = [t or "" for t in batch.column(own_text).to_pylist()]
                ids = [own.ids(t) for t in texts]
                columns = [batch.column(f.name) for f in fields] + [pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64())]
                if with_offsets:
                    spans = [own.offsets(t) for t in texts]
                    columns += [pa.array([[s[k] for s in row] for row in spans], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in [*fields, *added]])
        own.forget()

    return here.mapInArrow(run, T.StructType(fields + added))


def decode(rows: DataFrame, path: str, ids: str = "ids", pattern: str | None = None) -> DataFrame:
    """rows plus decoded binary, the bytes that the ids stand for, and text_decoded string. Null ids give nulls; an id outside the vocabulary fails."""
    spark, pattern = rows.sparkSession, pattern or _pattern()
    workers_see_package(spark)
    shared = _vocabulary(spark, path)
    here = rows.drop("decoded", "text_decoded")
    out = T.StructType([*here.schema.fields, T.StructField("decoded", T.BinaryType()), T.StructField("text_decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            found = [None if x is None else own.decode_bytes(x) for x in batch.column(ids).to_pylist()]
            read = [None if x is None else x.decode(errors="replace") for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary()), pa.array(read, pa.string())], out.names)

    return here.mapInArrow(run, out)


def _slices(batch: pa.RecordBatch, text: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of text, so that long texts don't meet in memory."""
    start, size = 0, 0
    lengths = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > chars:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """Encodes each text, decodes the ids, and returns doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip.

    The ids of one text are in memory at a time and don't leave the worker. A null text is an empty one: no ids, and the digest
    of nothing. Texts of any length are used whole; repeated rows give repeated results, an empty table an empty one. Other
    columns aren't carried along, so their names don't matter.
    """
    spark, pattern = docs.sparkSession, pattern or _pattern()
    workers_see_package(spark)
    shared = _vocabulary(spark, path)
    here = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("t"))
    out = T.StructType([here.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern, MORE)
        for batch in batches:
            rows = []
            for text in batch.column("t"):
                text = text.as_py() or ""
                ids = own.ids(text)
                back = own.decode_bytes(ids)
                decimal = ",".join(map(own.decimal.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.bool_())], out.names)

    return here.mapInArrow(run, out)


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
