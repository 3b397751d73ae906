"""Edge lists as text, and graphs as Parquet with a checked description."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.graph import Graph, build

VERSION = 1


class BadEdgeList(ValueError):
    """A line that isn't an edge, or no edges at all."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, src, dst, file) of the lines that should be edges; src or dst is null if they aren't."""
    line = F.trim(F.regexp_replace("value", r"(?U)\s+", " "))
    rows = spark.read.text(path).select(line.alias("line"), F.input_file_name().alias("file")).filter((F.col("line") != "") & ~F.col("line").rlike("^[#%]"))
    fields = F.split(F.trim(F.translate("line", ",", " ")), " +")
    return rows.select("line", *[F.get(fields, F.lit(i)).try_cast("long").alias(c) for i, c in enumerate(("src", "dst"))], "file")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a text file, plain or .gz. Blank lines and those that begin with # or % are skipped; commas count as blanks; fields after the second are ignored; anything else fails with the line."""
    bad = F.raise_error(F.concat(F.lit(f"not an edge in {path}: "), F.col("line"))).cast("long")
    return _lines(spark, path).select(F.coalesce("src", bad).alias("src"), F.coalesce("dst", bad).alias("dst"))


def check_edges(spark: SparkSession, path: str) -> None:
    """Raises BadEdgeList with file:line: for a line that isn't an edge. Lines are numbered only if there is one."""
    bad = _lines(spark, path).filter("src is null or dst is null").select("file", "line").first()
    if bad:
        same = lambda x: " ".join(x[0].split()) == bad.line
        place = spark.sparkContext.textFile(bad.file).zipWithIndex().filter(same).map(lambda x: x[1]).min()
        raise BadEdgeList(f"{bad.file}:{place + 1}: not an edge: {bad.line}")


def load_graph(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    check_edges(spark, path)
    edges = read_edges(spark, path)
    if edges.isEmpty():
        raise BadEdgeList(f"no edges in {path}")
    return build(edges, directed)


def write_edges(edges: DataFrame, path: str, header: str = "", compress: bool = False) -> None:
    """Tab-separated text files; header lines begin with #, in a file that sorts first."""
    lines = edges.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    if header:
        head = edges.sparkSession.createDataFrame([(f"# {x}",) for x in header.splitlines()], "value string").coalesce(1)
        lines = head.union(lines)
    lines.write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def _checksum(edges: DataFrame, vertices: DataFrame) -> tuple[str, int, int]:
    """A sum of row hashes, so the order of rows doesn't matter, and the counts."""
    whole = "decimal(38,0)"
    e = edges.agg(F.sum(F.xxhash64("src", "dst").cast(whole)).alias("s"), F.count("*").alias("n")).first()
    v = vertices.agg(F.sum(F.xxhash64("id").cast(whole)).alias("s"), F.count("*").alias("n")).first()
    return f"{e.s or 0}:{v.s or 0}", e.n, v.n


def write_store(graph: Graph, path: str) -> dict:
    """vertices/ and edges/ sorted by their first column, so that lookups skip row groups, and _meta, written last. Returns the description."""
    graph.vertices.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    spark = graph.edges.sparkSession
    checksum, edges, vertices = _checksum(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/vertices"))
    meta = {"version": VERSION, "directed": graph.directed, "num_nodes": vertices, "num_edges": edges, "checksum": checksum}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return meta


def open_store(spark: SparkSession, path: str) -> tuple[Graph, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    if meta.get("version") != VERSION:
        raise ValueError(f"{path}: version {meta.get('version')} isn't {VERSION}")
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), meta["directed"]), meta


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the files hold what was written."""
    graph, meta = open_store(spark, path)
    return _checksum(graph.edges, graph.vertices) == (meta["checksum"], meta["num_edges"], meta["num_nodes"])
