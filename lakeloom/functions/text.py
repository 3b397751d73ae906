"""Column expressions for transcripts: cleaning, time marks, video ids, languages."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hosts that carry a video id, and what an id looks like.
SHORT_HOST = "youtu.be"
LONG_HOSTS = ("youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com")
PATHS = ("embed", "shorts", "live", "v")
VIDEO_ID = "^[A-Za-z0-9_-]{11}$"


@F.pandas_udf(T.StringType())
def unescape_nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """HTML entities decoded once, then Unicode NFC; there are no built-in functions for either."""
    for s in texts:
        yield pd.Series([None if t is None else unicodedata.normalize("NFC", html.unescape(t)) for t in s], dtype=object)


def clean_marks(text: Column) -> Column:
    """Without zero-width characters, bracketed tags of 1 to 40 characters, a leading speaker mark and notes; white space is one blank."""
    out = F.regexp_replace(text, r"[\u200B-\u200D\u2060\uFEFF]", "")
    out = F.regexp_replace(out, r"\[[^\]\n]{1,40}\]", " ")
    out = F.regexp_replace(out, r"(?U)^\s*>>+\s*", "")
    out = F.translate(out, "♪♫", "  ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def clean_text(text: Column) -> Column:
    """Entities, NFC, then clean_marks(); a null text is an empty one."""
    return clean_marks(unescape_nfc(F.coalesce(text, F.lit(""))))


def timestamp(seconds: Column) -> Column:
    """mm:ss, from an hour on h:mm:ss; fractions are cut, negative numbers count as 0."""
    s = F.greatest(F.lit(0).cast("bigint"), seconds.cast("bigint"))
    h, m, r = F.floor(s / 3600).cast("bigint"), (F.floor(s / 60) % 60).cast("bigint"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def timestamp_url(video_id: Column, seconds: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id, F.lit("&t="), F.greatest(F.lit(0).cast("bigint"), seconds.cast("bigint")).cast("string"), F.lit("s"))


def video_id(value: Column) -> Column:
    """The id in a bare id or a link; null if there is none. A bare id wins before links are looked at."""
    s = F.trim(value)
    link = F.when(s.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), s).otherwise(F.concat(F.lit("https://"), s))
    host = F.regexp_replace(F.lower(F.try_parse_url(link, F.lit("HOST"))), r"^www\.", "")
    path = F.array_remove(F.split(F.coalesce(F.try_parse_url(link, F.lit("PATH")), F.lit("")), "/"), "")
    first, second = F.get(path, F.lit(0)), F.get(path, F.lit(1))
    found = F.when(host == SHORT_HOST, first).when(
        host.isin(*LONG_HOSTS), F.when(first == "watch", F.try_parse_url(link, F.lit("QUERY"), F.lit("v"))).when(first.isin(*PATHS), second)
    )
    return F.when(s.rlike(VIDEO_ID), s).when(found.rlike(VIDEO_ID), found)


def same_language(a: Column, b: Column) -> Column:
    """Whatever the case, equal as a whole or before the first dash."""
    return F.split_part(F.lower(a), F.lit("-"), F.lit(1)) == F.split_part(F.lower(b), F.lit("-"), F.lit(1))


def stripped(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_question(question: Column) -> Column:
    """Without outer white space, then without outer double quotes, then single ones, then white space again."""
    return stripped(F.btrim(F.btrim(stripped(question), F.lit('"')), F.lit("'")))


def csv_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def fingerprint(*parts: Column) -> Column:
    """Ten hexadecimal digits that name a choice of settings."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 10)


def crc32(text: Column) -> Column:
    """CRC-32 of the text's UTF-8, a long from 0 on."""
    return F.crc32(text.cast("binary"))


def hash64(value: Column) -> Column:
    """A 64-bit hash that spreads values over buckets."""
    return F.xxhash64(value)


def elapsed(start: Column, end: Column, unit: str = "MILLISECOND") -> Column:
    """Whole units between two times."""
    return F.timestamp_diff(unit, start, end)


def read_json(text: Column, schema: str) -> Column:
    """A struct of the schema; null for what isn't JSON."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def l2_normalised(vector: Column) -> Column:
    """The vector over its length; a vector of zeros stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
