"""Rows told apart by keys of a few of them, so that only those few move.

A join of documents with a table of ids shuffles every text. Here the ids set bits of a field of fixed size, which is small
enough to be broadcast whatever the number of ids; rows whose bit isn't set are certainly not in the table and stay where
they are. The others, which include a few that only share a bit, go through an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.runtime import materialize

#: The field has 16 bits for each key, and at most 2 ** MOST_BITS: 262,144 rows of 64 bits. A fuller field tells fewer rows apart; nothing is lost.
MOST_BITS = 24


def row_key(*columns: Column) -> Column:
    """32 hexadecimal digits that are the same for rows alike in all columns; null differs from any text."""
    parts = [F.coalesce(F.concat(F.lit("x"), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def marked(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """rows plus boolean maybe: false only where the row's key isn't among keys (column key, not null, repeats allowed)."""
    bits = 1 << min(MOST_BITS, max(10, (16 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    field = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word_")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS INT))")).alias("mask_"))
    field = materialize(field, "sift")
    found = rows.withColumn("place_", place)
    found = found.join(F.broadcast(field), F.shiftright("place_", 6) == F.col("word_"), "left")
    hit = F.expr("shiftrightunsigned(mask_, cast(place_ & 63 AS INT)) & 1") == 1
    return found.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("place_", "word_", "mask_")
