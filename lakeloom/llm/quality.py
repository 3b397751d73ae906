"""Quality rules as one projection of built-in functions.

A table of thresholds is compiled into boolean columns over counts of a text; there is no shuffle and no user
function. All comparisons are between whole numbers, so they are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.text import words

#: Words that running text in the supported languages hardly does without.
STOP_WORDS = (
    "the of and to in a is that for it with as was on be by at this are or from an "
    "der die das und den zu von ein ist mit nicht sich auf im dem auch es "
    "le la les de des et un une en que du est pour dans qui sur par "
    "el los las y del se con por para una su al"
).split()

#: Words in a window whose repetition counts.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text fails if 100 * count is above (or below) percent * total; it is not asked below at_least words."""

    name: str
    count: str
    above: bool
    percent: int
    total: str
    at_least: int = 0

    def fails(self) -> Column:
        left, right = F.col(self.count) * 100, F.col(self.total) * self.percent
        return (F.col("n_words") >= self.at_least) & ((left > right) if self.above else (left < right))

    def sql(self) -> str:
        return f"(n_words >= {self.at_least} AND 100 * {self.count} {'>' if self.above else '<'} {self.percent} * {self.total})"


#: These make base_failed; texts of fewer than MIN_WORDS words fail as well.
MIN_WORDS = 20
BASE = (Rule("repeated_windows", "n_repeat_words", True, 30, "n_words"),)

RULES = (
    Rule("short_words", "word_chars", False, 200, "n_words"),
    Rule("long_words", "word_chars", True, 1500, "n_words"),
    Rule("symbols", "n_symbols", True, 25, "n_words"),
    Rule("exclamations", "n_exclamations", True, 50, "n_words"),
    Rule("few_stop_words", "n_stop_words", False, 1, "n_words", at_least=50),
    Rule("repeated_lines", "n_dup_lines", True, 60, "n_lines", at_least=50),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_stop_words", "n_lines")


def _joined(i: Column) -> Column:
    return F.array_join(F.slice("w", i, WINDOW), " ")


def _repeat_words() -> Column:
    """Words covered by windows that occur more than once, from the sorted starts of such windows in column f."""
    gap = F.zip_with("f", F.slice("f", 2, F.greatest(F.size("f"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.when(F.size("f") > 0, F.aggregate(gap, F.lit(0), lambda x, y: x + y)).otherwise(0)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: struct row (all its columns), and COUNTS as longs.

    A null text counts as an empty one: all counts are 0. Columns of docs that share a name with a count stay
    inside row, so nothing clashes. Rows are independent: repeated rows give repeated results.
    """
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    df = df.withColumn("w", words(F.col("t"))).withColumn(
        "l", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    cases = sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())})
    # A window starts at each of the first n - 7 words.
    starts = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(1), F.size("w") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = df.select(
        "row",
        "w",
        starts.alias("i"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_exclamations"),
        F.size(F.filter("w", lambda x: x.isin(cases))).cast("long").alias("n_stop_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
    )
    # Equal windows have equal hashes, so distinct hashes settle most texts. In the others, windows that repeat have a
    # neighbour of the same hash in the order of hashes; only these are looked at as text.
    df = df.withColumn("h", F.transform("i", lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    placed = F.sort_array(F.zip_with("h", "i", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    df = df.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed))
    twins = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])))
    df = df.withColumn("c", F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    # The rest is exact: these windows are sorted as text, and neighbours compared.
    df = df.withColumn("s", F.sort_array(F.transform("c", lambda i: F.struct(_joined(i).alias("g"), i.alias("at")))))
    same = F.zip_with("s", F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), lambda a, b: F.when(a["g"] == b["g"], F.array(a["at"], b["at"])))
    df = df.withColumn("f", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    return df.withColumn("n_repeat_words", _repeat_words().cast("long")).select("row", *COUNTS)


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """counts() and base_failed, failed_rules (names of the other rules failed, in order) and kept."""
    base = F.col("n_words") < MIN_WORDS
    for rule in BASE:
        base = base | rule.fails()
    failed = F.concat_ws(",", *[F.when(r.fails(), F.lit(r.name)) for r in rules])
    df = counts(docs, text).withColumn("base_failed", base).withColumn("failed_rules", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text passes, with their own columns."""
    # The optimizer would move the condition, with all that it is made of, below the projections that hold the words once.
    # It can't move it past a column that isn't deterministic.
    found = quality(docs, text).withColumn("fence", F.monotonically_increasing_id())
    return found.filter(F.col("kept") & (F.col("fence") >= 0)).select("row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


_QUOTED = ", ".join(f"'{f}'" for f in sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())}))

OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
p AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM f) GROUP BY r),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '!'))::BIGINT AS n_exclamations,
      len(list_filter(w, lambda x: x IN ({_QUOTED})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p USING (r)),
v AS (SELECT *, n_words < {MIN_WORDS} OR {" OR ".join(r.sql() for r in BASE)} AS base_failed,
      concat_ws(',', {", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in RULES)}) AS failed_rules FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v"""
