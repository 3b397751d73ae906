"""Mixing sources to target weights by Pareto order sampling.

A source's documents are wanted target / size of source times each. The whole part of that ratio is allocated to every
document. The rest, f, is the part of the source's words that one more copy is to bring. A document's inclusion probability p
is f, a little more if the document is short for its source and a little less if it is long, so that the expected words are
as before and depend less on a few long documents. Documents are ranked by (u / (1 - u)) / (p / (1 - p)), u being a number in
(0, 1) made from the document, and the lowest ranks are taken until their words reach what the source lacks.

The sample is of a fixed size in words: a document that is larger than what is still lacking is passed over, and the ranks
after it go on, in PHASES cuts. A last document, the one whose size is nearest to the words still lacking, closes the gap.

A cut is found without sorting a source in one task: ranks are cut into about sqrt(documents) buckets, the words of each
bucket are summed before any shuffle, a running sum over buckets finds the one that holds the cut, and only that bucket is
sorted. Everything but the texts fits a few bytes a document; a document's copies follow from its own row and one row of its
source, so texts stay where they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.sift import marked, row_key
from lakeloom.llm.text import WORD
from lakeloom.runtime import materialize, small

#: A document is taken at most so many times.
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
#: u is a whole number below 2 ** U_BITS, and a half, over 2 ** U_BITS; the number is from the first hexadecimal digits of an MD5 sum.
U_BITS = 52
#: Cuts in the ranks of a source.
PHASES = 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From src (struct), size: one row per source with source_size and target.

    Sources take the weights in turn, in the order of their code points, null last. Targets share all sizes by weight and
    stop at MOST_COPIES times a source's size; what is over goes to the others by weight. In the order of
    MOST_COPIES * size / weight, a source is at its limit exactly if that is below the share per weight of what the
    sources before it left. The table has one row per source, however many documents there are.
    """
    t = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("src")
    n = F.row_number().over(order)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((n - 1) % len(weights) + 1).cast("int")))
    before = Window.orderBy(F.col("source_size") * MOST_COPIES / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * MOST_COPIES).over(before), F.lit(0))
    share = left.cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    t = t.withColumn("share", share).withColumn("full", F.col("source_size") * MOST_COPIES / F.col("weight") < F.col("share"))
    # The first source that isn't at its limit has the share of all that aren't.
    t = t.withColumn("level", F.min(F.when(~F.col("full"), F.struct((F.col("source_size") * MOST_COPIES / F.col("weight")).alias("a"), "src", "share"))).over(everything)["share"])
    limit = (F.col("source_size") * MOST_COPIES).cast("double")
    target = F.when(F.col("full"), limit).otherwise(F.least(limit, F.col("weight").cast("double") * F.col("level")))
    return t.select("src", "source_size", F.round(target, 6).alias("target"))


def inclusion(size: Column, f: Column, usual: Column, spread: Column) -> Column:
    """p of a document: f + f * (1 - f) * (t - spread), t being min(1, usual / size) and spread the mean of t by words.

    The sum of p * size over a source is f * its size, and p is between f ** 2 and 1 - (1 - f) ** 2.
    """
    t = F.least(size, usual).cast("double") / size.cast("double")
    return f + f * (F.lit(1.0) - f) * (t - spread)


def _rank(size: Column, key: Column, copy: Column) -> Column:
    """The odds of u over the odds of p, q, as q / (1 + q)."""
    u = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), copy.cast("string"))), 1, U_BITS // 4), 16, 10).cast("double")
    u = (u + F.lit(0.5)) / F.lit(float(1 << U_BITS))
    p = inclusion(size, F.col("f"), F.col("usual"), F.col("spread"))
    q = (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))
    return F.when((size > 0) & (F.col("f") > 0), q / (F.lit(1.0) + q))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """row (struct of all columns), doc_id, src, size, key: the same for rows alike in id, source and text."""
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[doc_id].alias("doc_id"),
        F.struct(docs[source].isNull().alias("last"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("name")).alias("src"),
        docs[text].cast("string").alias("t"),
    )
    size = F.regexp_count(F.coalesce(F.col("t"), F.lit("")), F.lit(WORD)).cast("long")
    return rows.select("row", "doc_id", "src", size.alias("size"), row_key(F.col("doc_id"), F.when(~F.col("src.last"), F.col("src.name")), F.col("t")).alias("key"))


def _numbered(rows: DataFrame, again: DataFrame) -> DataFrame:
    """rows plus number: 0, 1, ... among rows of one key. again: the keys of several rows. Only rows of such keys move."""
    found = marked(rows, again)
    few = materialize(found.filter("maybe").drop("maybe").withColumn("part", F.spark_partition_id()), "mix-repeated")
    # A key's rows are numbered inside each part of the table, after those of the parts before it.
    before = few.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("key")) - 1
    few = few.withColumn("inside", inside).join(before.drop("n"), ["key", "part"]).withColumn("number", (F.col("before") + F.col("inside")).cast("long"))
    return found.filter("not maybe").drop("maybe").withColumn("number", F.lit(0).cast("long")).unionByName(few.drop("part", "before", "inside"))


def _place() -> Column:
    return F.struct("rank", "key", "number")


def _taken(k: int) -> Column:
    """Whether a row is taken by one of the first k cuts. Columns of its source: gap0, cut1, last1, gap1, ..."""
    found = F.lit(False)
    for i in range(1, k + 1):
        sure = F.col("bucket") < F.coalesce(F.col(f"cut{i}"), F.lit(1 << 62))
        edge = (F.col("bucket") == F.col(f"cut{i}")) & F.coalesce(_place() <= F.col(f"last{i}"), F.lit(False))
        found = found | ((F.col("size") <= F.col(f"gap{i - 1}")) & (sure | edge))
    return F.col("rank").isNotNull() & found


def _with_plan(rows: DataFrame, plan: DataFrame, buckets: int) -> DataFrame:
    """rows with the columns of their source, rank and bucket. The plan has a row for each source; if it is too large to be sent to all, the join shuffles."""
    found = rows.join(small(plan, 200), "src").withColumn("rank", _rank(F.col("size"), F.col("key"), F.col("number")))
    return found.withColumn("bucket", F.floor(F.col("rank") * buckets).cast("long"))


def _plan(sizes: DataFrame, weights: tuple[int, ...]) -> tuple[DataFrame, int]:
    """One row per source, with all that tells which of its documents are taken how often; and the number of buckets. sizes: src, size, key, number."""
    buckets = 1 << max(0, math.isqrt(sizes.count()).bit_length())
    plan = targets(sizes, weights)
    whole = F.floor(F.col("target") / F.col("source_size"))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long"))
    plan = plan.withColumn("gap0", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumn("f", F.when(F.col("source_size") > 0, F.col("gap0") / F.col("source_size").cast("double")).otherwise(0.0))
    n = sizes.filter("size > 0").groupBy("src").agg(F.count("*").alias("n"))
    plan = plan.join(n, "src", "left").withColumn("usual", F.expr("(source_size + n - 1) div n"))  # the mean size, rounded up
    plan = materialize(plan.drop("n"), "mix-plan")
    least = sizes.filter("size > 0").join(small(plan.select("src", "usual"), 100), "src").groupBy("src").agg(F.sum(F.least("size", "usual")).alias("least"))
    plan = plan.join(least, "src", "left").withColumn("spread", F.col("least").cast("double") / F.col("source_size").cast("double")).drop("least")
    plan = materialize(plan, "mix-plan")
    ranked = materialize(_with_plan(sizes, plan.select("src", "f", "usual", "spread"), buckets).select("src", "size", "key", "number", "rank", "bucket"), "mix-ranks")
    for k in range(1, PHASES + 1):
        pool = ranked.join(small(plan, 600), "src").filter((F.col("size") > 0) & (F.col("size") <= F.col(f"gap{k - 1}")) & F.col("rank").isNotNull() & ~_taken(k - 1))
        pool = pool.select("src", "size", "rank", "key", "number", "bucket", F.col(f"gap{k - 1}").alias("gap"))
        ordered = Window.partitionBy("src").orderBy("bucket")
        sums = pool.groupBy("src", "gap", "bucket").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(ordered))
        cut = sums.groupBy("src").agg(
            F.min(F.when(F.col("upto") > F.col("gap"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("already")))).alias("cut"), F.max("upto").alias("all")
        )
        cut = materialize(cut, "mix-cut")
        inside = pool.join(small(cut.select("src", "cut"), 100), "src").filter(F.col("bucket") == F.col("cut.bucket"))
        inside = inside.withColumn("upto", F.col("cut.already") + F.sum("size").over(Window.partitionBy("src").orderBy("rank", "key", "number").rowsBetween(Window.unboundedPreceding, 0)))
        inside = inside.filter("upto <= gap").groupBy("src").agg(F.max(_place()).alias(f"last{k}"), F.max("upto").alias("reached"))
        plan = plan.join(cut, "src", "left").join(inside, "src", "left")
        # Without a pool nothing is cut off and nothing is added; without a cut all of the pool is taken.
        reached = F.when(F.col("cut").isNull(), F.coalesce("all", F.lit(0))).otherwise(F.coalesce("reached", "cut.already"))
        plan = plan.withColumn(f"gap{k}", F.col(f"gap{k - 1}") - reached).withColumn(f"cut{k}", F.col("cut.bucket")).drop("cut", "all", "reached")
        plan = materialize(plan, "mix-plan")
    gap = F.col(f"gap{PHASES}")
    off = F.abs(F.col("size") - gap)
    more = ranked.join(small(plan, 600), "src").filter((F.col("size") > 0) & F.col("rank").isNotNull() & ~_taken(PHASES) & (off < gap))
    more = more.groupBy("src").agg(F.min(F.struct(off.alias("off"), "rank", "key", "number")).alias("more"))
    return materialize(plan.join(more, "src", "left"), "mix-plan"), buckets


def _copies() -> Column:
    one = F.coalesce((F.col("key") == F.col("more.key")) & (F.col("number") == F.col("more.number")), F.lit(False))
    copies = F.col("whole") + F.when(_taken(PHASES) | one, 1).otherwise(0)
    return F.least(copies, F.lit(MOST_COPIES)).cast("long")


def _narrow(docs: DataFrame, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, src, size, key and number of each row, written once; and the keys of several rows."""
    sizes = materialize(_sized(docs, doc_id, text, source).drop("row"), "mix-sizes")
    again = materialize(sizes.groupBy("key").count().filter("count > 1").select("key"), "mix-again")
    return materialize(_numbered(sizes, again), "mix-numbers"), again


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken = copies * size.

    Null texts have size 0. Documents without words take part in nothing: they get the whole copies of their source, and
    taken is 0. Rows alike in id (or without one), source and text are rows of their own: each has its u, from its number among
    them. If all sizes are 0, targets and copies are 0. Reruns agree. An empty table gives an empty one. Other columns aren't
    carried along, so their names don't matter.
    """
    sizes, _ = _narrow(docs, doc_id, text, source)
    plan, buckets = _plan(sizes, weights)
    each = _with_plan(sizes, plan, buckets)
    return each.select("doc_id", F.when(~F.col("src.last"), F.col("src.name")).alias("source"), "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed corpus: each row of docs as often as mix() takes it, with its own columns, whatever their names.

    Nulls, empty texts and repeated rows are as in mix(). Rows are decided where they are; only those alike in id, source and
    text move, to be numbered.
    """
    sizes, again = _narrow(docs, doc_id, text, source)
    plan, buckets = _plan(sizes, weights)
    rows = _with_plan(_numbered(_sized(docs, doc_id, text, source).select("row", "src", "size", "key"), again), plan, buckets)
    rows = rows.select("row", _copies().cast("int").alias("copies")).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op5(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


_WEIGHT = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))


def _sql_cuts() -> str:
    """One common table expression for each cut: taken{k} and gap{k} from taken{k - 1} and gap{k - 1}."""
    found = []
    for k in range(1, PHASES + 1):
        may = f"rank IS NOT NULL AND NOT taken{k - 1} AND size <= gap{k - 1}"
        found.append(f"""w{k} AS (SELECT *, {may} AS may{k}, sum(CASE WHEN {may} THEN size ELSE 0 END) OVER (PARTITION BY last, name ORDER BY rank, key, number ROWS UNBOUNDED PRECEDING) AS upto{k} FROM g{k - 1}),
g{k} AS (SELECT *, taken{k - 1} OR (may{k} AND upto{k} <= gap{k - 1}) AS taken{k}, gap{k - 1} - coalesce(max(CASE WHEN may{k} AND upto{k} <= gap{k - 1} THEN upto{k} END) OVER (PARTITION BY last, name), 0) AS gap{k} FROM w{k}),""")
    return "\n".join(found)


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source IS NULL AS last, coalesce(source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      md5(coalesce('x' || CAST(doc_id AS VARCHAR), '-') || '|' || coalesce('x' || source, '-') || '|' || coalesce('x' || text, '-')) AS key FROM documents),
i AS (SELECT *, row_number() OVER (PARTITION BY key) - 1 AS number FROM d),
v AS (SELECT *, (('0x' || substr(md5(key || ':' || CAST(number AS VARCHAR)), 1, {U_BITS // 4}))::BIGINT::DOUBLE + 0.5::DOUBLE) / {1 << U_BITS}::DOUBLE AS u FROM i),
a AS (SELECT last, name, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS full_, row_number() OVER (ORDER BY last, name) AS n FROM d GROUP BY last, name),
b AS (SELECT *, CASE (n - 1) % {len(WEIGHTS)} {_WEIGHT} END AS weight FROM a),
c AS (SELECT *, {MOST_COPIES} * source_size / weight AS lim,
      (sum(source_size) OVER () - coalesce(sum({MOST_COPIES} * source_size) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS share
      FROM b WINDOW w AS (ORDER BY {MOST_COPIES} * source_size / weight, last, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, (SELECT share FROM c WHERE NOT (lim < share) ORDER BY lim, last, name LIMIT 1) AS level FROM c),
s AS (SELECT *, round(CASE WHEN lim < share THEN {MOST_COPIES} * source_size::DOUBLE ELSE least({MOST_COPIES} * source_size::DOUBLE, weight::DOUBLE * level) END, 6) AS target FROM e),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, (source_size + full_ - 1) // nullif(full_, 0) AS usual FROM s),
k AS (SELECT *, target - whole * source_size AS gap0, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size::DOUBLE ELSE 0 END AS f FROM t),
h AS (SELECT last, name, sum(least(size, usual))::DOUBLE / any_value(source_size)::DOUBLE AS spread FROM d JOIN k USING (last, name) WHERE size > 0 GROUP BY last, name),
p AS (SELECT v.*, source_size, target, whole, gap0, f, f + f * (1::DOUBLE - f) * (least(size, usual)::DOUBLE / size::DOUBLE - spread) AS p FROM v JOIN k USING (last, name) LEFT JOIN h USING (last, name)),
q AS (SELECT *, CASE WHEN size > 0 AND f > 0 THEN (u / (1::DOUBLE - u)) / (p / (1::DOUBLE - p)) END AS q FROM p),
g0 AS (SELECT *, q / (1::DOUBLE + q) AS rank, false AS taken0 FROM q),
{_sql_cuts()}
z AS (SELECT *, rank IS NOT NULL AND NOT taken{PHASES} AND abs(size - gap{PHASES}) < gap{PHASES} AS near FROM g{PHASES}),
o AS (SELECT *, near AND row_number() OVER (PARTITION BY last, name ORDER BY near DESC, abs(size - gap{PHASES}), rank, key, number) = 1 AS one FROM z)
SELECT doc_id, size, source_size, target, (size * least({MOST_COPIES}, whole + CASE WHEN taken{PHASES} OR one THEN 1 ELSE 0 END))::BIGINT AS taken FROM o"""
