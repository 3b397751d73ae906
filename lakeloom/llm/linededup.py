"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by all pages of the host; lines above the ratio go. Lines are
counted by 64-bit hashes first, so that no text is shuffled. A host's lines above the ratio are few: each is on more than
ratio * pages, so there are at most (mean lines of a page) / ratio of them. They are gathered in one row per host. A second
pass counts their texts, which settles hashes that collide, and a third drops them inside each row.

Where copies of whole pages are still among the rows, a page can be counted once for each different content, so that the
lines of a page that was copied a thousand times aren't boilerplate for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.runtime import BROADCAST_BYTES, materialize

#: A line goes if it is on more than this part of its host's pages, and on FEWEST pages or more: a line of one page repeats nothing.
RATIO = 0.2
FEWEST = 2
#: For texts of a source: a source is much larger than a site, and what it repeats is rarer.
SOURCE_RATIO, SOURCE_FEWEST = 0.03, 5
#: ASCII white space, which doesn't count at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, password and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1))


def html_lines(html: Column) -> Column:
    """The text between tags, a line for each run of it; scripts, styles and comments go."""
    bare = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", "")
    return _full(F.split(F.regexp_replace(bare, "<[^>]*>", "\n"), "\n"))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _full(lines: Column) -> Column:
    return F.filter(F.transform(lines, _bare), lambda x: x != "")


def _with_hosts(rows: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """rows with the array column of found's row for the host. found is broadcast if its measured size allows it; else the join shuffles, and adaptive execution splits a hot host."""
    found = materialize(found, "line-hosts")
    size = found.agg(F.sum(F.length(F.to_json(column)) + F.length("host") + 64)).first()[0] or 0
    found = found.withColumnRenamed("host", "host_")
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    return rows.join(found, rows["host"] == found["host_"], "left").drop("host_")


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    """Pages for each value of by: rows, or, if rows has a column content, different contents."""
    if "content" in rows.columns:
        rows = rows.select(*by, "content").distinct()
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def line_dedup(docs: DataFrame, host: Column, lines: Column, ratio: float = RATIO, fewest: int = FEWEST, copies_once: bool = False) -> DataFrame:
    """Struct row (all columns of docs), host, lines (array kept), n_lines, n_dropped.

    Lines are compared without outer ASCII white space; blank lines never go and don't count in n_lines. A line counts once a
    page. A page is a row: repeated rows are pages of their own, unless copies_once; then pages of a host whose lines are all
    the same count as one, in the line's count and in the host's. A null or empty host is a host like any other. Columns of
    docs stay inside row, so names can't clash. Null, empty and very long texts are pages like any other.
    """
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(lines, F.array().cast("array<string>")).alias("all"),
    )
    rows = rows.withColumn("full", _full(F.col("all")))
    content = ["content"] if copies_once else []
    counted = rows.withColumn("content", F.struct(F.xxhash64("all"), F.xxhash64(F.lit(1), "all"))) if copies_once else rows
    pages = _counted(counted.select("host", *content), "host").withColumnRenamed("n", "pages")
    often = (F.col("n") > F.col("pages") * ratio) & (F.col("n") >= fewest)
    hashes = counted.select("host", *content, F.explode(F.array_distinct(F.transform("full", lambda x: F.xxhash64(x)))).alias("h"))
    hashes = _counted(hashes, "host", "h").filter(F.col("n") >= fewest)
    hashes = hashes.join(pages, "host").filter(often).groupBy("host").agg(F.collect_set("h").alias("hs"))
    likely = _with_hosts(counted, hashes, "hs").filter(F.col("hs").isNotNull())
    likely = likely.withColumn("some", F.array_intersect(F.transform("full", lambda x: F.xxhash64(x)), "hs")).filter(F.size("some") > 0)
    texts = likely.select("host", *content, F.explode(F.filter(F.array_distinct("full"), lambda x: F.array_contains("some", F.xxhash64(x)))).alias("line"))
    texts = _counted(texts, "host", "line")
    texts = texts.join(pages, "host").filter(often).groupBy("host").agg(F.collect_set("line").alias("drop"))
    # A page's own boilerplate is found by hashing, so its lines aren't held against all of the host's.
    rows = _with_hosts(rows, texts, "drop").withColumn("drop", F.array_intersect("full", "drop"))
    kept = F.filter("all", lambda x: ~F.array_contains("drop", _bare(x)))
    rows = rows.withColumn("lines", F.when(F.coalesce(F.size("drop"), F.lit(0)) <= 0, F.col("all")).otherwise(kept))
    return rows.select("row", "host", "lines", F.size("full").cast("long").alias("n_lines"), (F.size("all") - F.size("lines")).cast("long").alias("n_dropped"))


def without_boilerplate(docs: DataFrame, text: str = "text", source: str = "source", ratio: float = SOURCE_RATIO, fewest: int = SOURCE_FEWEST) -> DataFrame:
    """docs with the lines of text that are boilerplate of their source dropped; the other columns are as they were, null texts too.

    Copies of a document count once, as near-dedup is to find them whole.
    """
    found = line_dedup(docs, docs[source], text_lines(docs[text]), ratio, fewest, copies_once=True)
    new = F.when(F.col("row")[text].isNotNull(), F.array_join("lines", "\n"))
    return found.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def op3(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = line_dedup(pages, host_of(pages["url"]), html_lines(pages["html"]))
    return found.select(F.col("row.page_id").alias("page_id"), "host", "n_lines", "n_dropped", F.array_join("lines", "\n").alias("text"))


_SQL_BLANKS = " || ".join(f"chr({ord(c)})" for c in BLANKS)

OP3_SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
      list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x, {_SQL_BLANKS})), lambda x: x <> '') AS l FROM pages),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
n AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(l)) AS line FROM p) GROUP BY host, line),
b AS (SELECT n.host, line FROM n JOIN h USING (host) WHERE n > pages * {RATIO}::DOUBLE AND n >= {FEWEST}),
x AS (SELECT r, host, i, l[i] AS line FROM (SELECT r, host, l, unnest(range(1, len(l) + 1)) AS i FROM p)),
k AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS c FROM x ANTI JOIN b USING (host, line) GROUP BY r)
SELECT page_id, host, len(l)::BIGINT AS n_lines, (len(l) - coalesce(c, 0))::BIGINT AS n_dropped, coalesce(t, '') AS text FROM p LEFT JOIN k USING (r)"""
