"""The queries on the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import cleansing as cl
from lakeloom.functions import text as tx
from lakeloom.operators import graph as gr
from lakeloom.operators import paging as pg
from lakeloom.operators import relational as rel
from lakeloom.operators import retrieval as rt
from lakeloom.runtime import materialize, read
from lakeloom.sources import reports as rp

QUERIES = {}
ORACLES = {}


def query(sql=None):
    """Registers a query under its function's name, with its DuckDB SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
SELECT p_type, CAST(year(o_orderdate) AS INT) AS order_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE o_orderdate IS NOT NULL GROUP BY ALL""")
def revenue_by_type_year(spark, sf_dir):
    lineitem, orders, part = read(spark, sf_dir, "lineitem", "orders", "part")
    return (
        lineitem.join(orders.filter(F.col("o_orderdate").isNotNull()), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_type", F.year("o_orderdate").alias("order_year"))
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
        .orderBy("order_year", F.desc("revenue"))
    )


def day(column):
    return F.to_date(column)


# --- rows, codes, repairs -------------------------------------------------------------------------------------------


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS rn FROM orders WHERE o_custkey IS NOT NULL) WHERE rn = 1""")
def latest_order_per_customer(spark, sf_dir):
    (orders,) = read(spark, sf_dir, "orders")
    newest = rel.latest(orders.filter(F.col("o_custkey").isNotNull()), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.asc("o_orderkey")])
    return newest.select("o_custkey", "o_orderkey", "o_totalprice")


_VERSIONS = """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS start_dt,
 CAST(lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - INTERVAL 1 DAY AS DATE) AS end_dt FROM orders"""


def _order_versions(spark, sf_dir):
    (orders,) = read(spark, sf_dir, "orders")
    return rel.valid_until(orders.select("o_custkey", "o_orderkey", day("o_orderdate").alias("start_dt")), ["o_custkey"], "start_dt", ["o_orderkey"], "end_dt")


@query(_VERSIONS)
def order_validity_ranges(spark, sf_dir):
    return _order_versions(spark, sf_dir)


@query(f"SELECT o_custkey, o_orderkey, start_dt FROM ({_VERSIONS}) WHERE end_dt IS NULL")
def current_versions_only(spark, sf_dir):
    return _order_versions(spark, sf_dir).filter(F.col("end_dt").isNull()).select("o_custkey", "o_orderkey", "start_dt")


@query("""
SELECT l_orderkey, l_linenumber, CASE upper(trim(' ' || lower(l_returnflag))) WHEN 'M' THEN 'Mountain' WHEN 'R' THEN 'Road' WHEN 'S' THEN 'Other Sales' WHEN 'T' THEN 'Touring' ELSE 'n/a' END AS line_name FROM lineitem""")
def decode_status_simple_case(spark, sf_dir):
    (lines,) = read(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", cl.decode(F.concat(F.lit(" "), F.lower("l_returnflag")), cl.PRODUCT_LINE).alias("line_name"))


@query("""
SELECT event_id, CASE WHEN upper(trim(k)) IN ('F', 'FEMALE') THEN 'Female' WHEN upper(trim(k)) IN ('M', 'MALE') THEN 'Male' ELSE 'n/a' END AS gender,
 CASE WHEN trim(c) = 'DE' THEN 'Germany' WHEN trim(c) IN ('US', 'USA') THEN 'United States' WHEN trim(c) = '' OR c IS NULL THEN 'n/a' ELSE trim(c) END AS country
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'f ' WHEN 1 THEN 'MALE' WHEN 2 THEN 'Female' WHEN 3 THEN NULL ELSE 'x' END AS k,
 CASE event_id % 6 WHEN 0 THEN 'DE' WHEN 1 THEN ' US' WHEN 2 THEN 'USA' WHEN 3 THEN '  ' WHEN 4 THEN NULL ELSE ' France' END AS c FROM events)""")
def decode_membership_case(spark, sf_dir):
    (events,) = read(spark, sf_dir, "events")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % n + 1).cast("int"))
    return events.select("event_id", cl.decode(pick(5, "f ", "MALE", "Female", None, "x"), cl.GENDER_WORDS).alias("gender"), cl.country(pick(6, "DE", " US", "USA", "  ", None, " France")).alias("country"))


@query("SELECT c_custkey, replace(substr(c_name, 1, 5), '-', '_') AS part_a, substr(c_name, 7) AS part_b FROM (SELECT c_custkey, substr(c_name, 1, 2) || '-' || substr(c_name, 3) AS c_name FROM customer)")
def split_composite_key(spark, sf_dir):
    (customer,) = read(spark, sf_dir, "customer")
    key = F.concat(F.substring("c_name", 1, 2), F.lit("-"), F.substring("c_name", 3, 100))
    return customer.select("c_custkey", cl.category_of(key).alias("part_a"), cl.product_of(key).alias("part_b"))


@query("""
SELECT s_suppkey, CASE WHEN trim(n) LIKE 'NAS%' THEN substr(trim(n), 4) ELSE trim(n) END AS bare, replace(trim(s_name), '#', '') AS no_hash, replace(trim(d), '-', '') AS no_dash
FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN ' NAS' || s_name ELSE s_name END AS n, 'AW-' || s_suppkey AS d FROM supplier)""")
def prefix_strip(spark, sf_dir):
    (supplier,) = read(spark, sf_dir, "supplier")
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" NAS"), "s_name")).otherwise(F.col("s_name"))
    dashed = F.concat(F.lit("AW-"), F.col("s_suppkey").cast("string"))
    return supplier.select("s_suppkey", cl.without_prefix(name, "NAS").alias("bare"), F.replace(F.trim("s_name"), F.lit("#"), F.lit("")).alias("no_hash"), cl.without_dashes(dashed).alias("no_dash"))


@query("""
SELECT l_orderkey, l_linenumber, coalesce(nullif(CAST(l_quantity AS INT) % 7, 0), 0) AS cost, (CAST(floor(l_extendedprice) AS BIGINT) // nullif(CAST(l_quantity AS BIGINT) % 5, 0)) AS unit, abs(-CAST(l_quantity AS INT)) AS size FROM lineitem""")
def null_default_and_nullif(spark, sf_dir):
    (lines,) = read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        F.coalesce(F.nullif(q.cast("int") % 7, F.lit(0)), F.lit(0)).alias("cost"),
        F.call_function("div", F.expr("cast(l_extendedprice as bigint)"), F.nullif(q.cast("long") % 5, F.lit(0))).alias("unit"),
        F.abs(-q.cast("int")).alias("size"),
    )


_DIRTY = """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q,
 CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN NULL WHEN 1 THEN -5 WHEN 2 THEN 0 ELSE 7 END AS p,
 CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -3 WHEN 3 THEN CAST(l_quantity AS INT) * 7 ELSE CAST(l_quantity AS INT) * 7 + 9 END AS s FROM lineitem"""


@query(f"""
WITH d AS ({_DIRTY}), f AS (SELECT *, CASE WHEN s IS NULL OR s <= 0 OR s <> q * abs(p) THEN q * abs(p) ELSE s END AS sales FROM d)
SELECT l_orderkey, l_linenumber, sales::INT AS sales, CASE WHEN p IS NULL OR p <= 0 THEN sales // nullif(q, 0) ELSE p END::BIGINT AS price FROM f""")
def repair_amounts(spark, sf_dir):
    read(spark, sf_dir, "lineitem")[0].createOrReplaceTempView("lineitem_raw")
    dirty = spark.sql(_DIRTY.replace("FROM lineitem", "FROM lineitem_raw"))
    fixed = dirty.withColumn("sales", cl.repaired_sales(F.col("s"), F.col("q"), F.col("p")))
    return fixed.select("l_orderkey", "l_linenumber", "sales", cl.repaired_price(F.col("p"), F.col("sales"), F.col("q")).cast("long").alias("price"))


@query("""
SELECT o_orderkey, CASE WHEN length(CAST(n AS VARCHAR)) = 8 THEN CAST(try_strptime(CAST(n AS VARCHAR), '%Y%m%d') AS DATE) END AS order_dt
FROM (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 0 WHEN 1 THEN 2024010 WHEN 2 THEN 20231331 ELSE CAST(strftime(o_orderdate, '%Y%m%d') AS INT) END AS n FROM orders)""")
def yyyymmdd_to_date(spark, sf_dir):
    (orders,) = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 10
    n = F.when(k == 0, 0).when(k == 1, 2024010).when(k == 2, 20231331).otherwise(F.date_format("o_orderdate", "yyyyMMdd").cast("int"))
    return orders.select("o_orderkey", cl.date_of(n).alias("order_dt"))


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) > DATE '1996-01-01' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_dt FROM orders")
def future_date_to_null(spark, sf_dir):
    (orders,) = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", cl.not_after(day("o_orderdate"), date(1996, 1, 1)).alias("order_dt"))


# --- keys, dimensions, facts ----------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS customer_key, c_custkey FROM customer")
def surrogate_keys_single(spark, sf_dir):
    return rel.numbered(read(spark, sf_dir, "customer")[0].select("c_custkey"), ["c_custkey"], "customer_key")


@query("SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS product_key, p_size, p_partkey FROM part")
def surrogate_keys_composite(spark, sf_dir):
    return rel.numbered(read(spark, sf_dir, "part")[0].select("p_size", "p_partkey"), ["p_size", "p_partkey"], "product_key")


_DIM_CUSTOMER = """SELECT row_number() OVER (ORDER BY c_custkey) AS customer_key, c_custkey AS customer_id, trim(c_name) AS customer_name, coalesce(n_name, 'n/a') AS country, coalesce(r_name, 'n/a') AS region,
 CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment ELSE coalesce(n_name, 'n/a') END AS segment
 FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""


def _dim_customer(spark, sf_dir):
    customer, nation, region = read(spark, sf_dir, "customer", "nation", "region")
    rows = customer.join(nation.filter("n_nationkey % 5 <> 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    na = F.lit("n/a")
    rows = rows.select(
        F.col("c_custkey").alias("customer_id"),
        F.trim("c_name").alias("customer_name"),
        F.coalesce("n_name", na).alias("country"),
        F.coalesce("r_name", na).alias("region"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).otherwise(F.coalesce("n_name", na)).alias("segment"),
    )
    return rel.numbered(rows, ["customer_id"], "customer_key")


@query(_DIM_CUSTOMER)
def dim_customer_view(spark, sf_dir):
    return _dim_customer(spark, sf_dir)


_DIM_PRODUCT = """SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS product_key, p_partkey AS product_id, p_name AS product_name, c.category FROM part
 LEFT JOIN (SELECT DISTINCT p_type, lower(p_type) AS category FROM part WHERE p_type <> 'PROMO') c USING (p_type)"""


def _dim_product(spark, sf_dir):
    (part,) = read(spark, sf_dir, "part")
    category = part.filter("p_type <> 'PROMO'").select("p_type", F.lower("p_type").alias("category")).distinct()
    rows = part.join(category, "p_type", "left").select("p_size", F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), "category")
    return rel.numbered(rows, ["p_size", "product_id"], "product_key").drop("p_size")


@query(_DIM_PRODUCT)
def dim_product_view(spark, sf_dir):
    return _dim_product(spark, sf_dir)


@query(f"""
WITH c AS ({_DIM_CUSTOMER}), p AS ({_DIM_PRODUCT})
SELECT l_orderkey AS order_number, l_linenumber AS line, product_key, customer_key, CAST(o_orderdate AS DATE) AS order_date, l_extendedprice AS sales_amount
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN p ON l_partkey = product_id LEFT JOIN c ON o_custkey = customer_id""")
def fact_sales_view(spark, sf_dir):
    lines, orders = read(spark, sf_dir, "lineitem", "orders")
    p = _dim_product(spark, sf_dir).select("product_id", "product_key")
    c = _dim_customer(spark, sf_dir).select("customer_id", "customer_key")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(p, F.col("l_partkey") == F.col("product_id"), "left").join(c, F.col("o_custkey") == F.col("customer_id"), "left")
    return rows.select(F.col("l_orderkey").alias("order_number"), F.col("l_linenumber").alias("line"), "product_key", "customer_key", day("o_orderdate").alias("order_date"), F.col("l_extendedprice").alias("sales_amount"))


# --- checks ---------------------------------------------------------------------------------------------------------

_ORPHANS = """SELECT l_orderkey, l_linenumber FROM {l} l
 WHERE NOT EXISTS (SELECT 1 FROM {o} o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderkey % 11 <> 0) OR NOT EXISTS (SELECT 1 FROM {p} p WHERE p.p_partkey = l.l_partkey AND p.p_partkey % 13 <> 0)"""


@query(_ORPHANS.format(l="lineitem", o="orders", p="part"))
def orphans_not_exists_or(spark, sf_dir):
    lines, orders, part = read(spark, sf_dir, "lineitem", "orders", "part")
    orders, part = orders.filter("o_orderkey % 11 <> 0"), part.filter("p_partkey % 13 <> 0")
    on = F.col("l_orderkey") == F.col("o_orderkey")
    lacking = lines.join(orders, on, "left_anti").unionByName(lines.join(orders, on, "left_semi").join(part, F.col("l_partkey") == F.col("p_partkey"), "left_anti"))
    return lacking.select("l_orderkey", "l_linenumber")


@query(_ORPHANS.format(l="lineitem", o="orders", p="part"))
def orphans_left_join_null(spark, sf_dir):
    lines, orders, part = read(spark, sf_dir, "lineitem", "orders", "part")
    o = orders.filter("o_orderkey % 11 <> 0").select("o_orderkey")
    p = part.filter("p_partkey % 13 <> 0").select("p_partkey")
    rows = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.filter(F.col("o_orderkey").isNull() | F.col("p_partkey").isNull()).select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_keys_having(spark, sf_dir):
    return read(spark, sf_dir, "orders")[0].groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT nullif(o_custkey % 50, 7) AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 300 OR nullif(k, -1) IS NULL")
def having_or_null_key(spark, sf_dir):
    return read(spark, sf_dir, "orders")[0].groupBy(F.nullif(F.col("o_custkey") % 50, F.lit(7)).alias("k")).agg(F.count("*").alias("n")).filter("n > 300 or k is null")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey HAVING count(*) <> 1")
def open_version_exactly_one(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")[0].filter("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n <> 1")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")[0].select("l_returnflag", "l_linestatus").distinct()


@query("SELECT DISTINCT p_type FROM part ORDER BY p_type")
def distinct_ordered(spark, sf_dir):
    return read(spark, sf_dir, "part")[0].select("p_type").distinct().orderBy("p_type")


@query("SELECT 'customer' AS dataset, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def row_counts_union_all(spark, sf_dir):
    count = lambda t: read(spark, sf_dir, t)[0].agg(F.count("*").alias("n")).select(F.lit(t).alias("dataset"), "n")
    return count("customer").unionByName(count("part")).unionByName(count("lineitem"))


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN ' ' || c_name ELSE c_name END AS n FROM customer) WHERE n <> trim(n)")
def names_untrimmed(spark, sf_dir):
    (customer,) = read(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit(" "), "c_name")).otherwise(F.col("c_name"))
    return customer.withColumn("n", name).filter(F.col("n") != F.trim("n")).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate")
def date_order_violations(spark, sf_dir):
    lines, orders = read(spark, sf_dir, "lineitem", "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter(F.col("o_orderdate") > F.col("l_shipdate")).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM ({_DIRTY}) WHERE s <> q * p OR s IS NULL OR p IS NULL OR q IS NULL OR s <= 0 OR p <= 0 OR q <= 0")
def amount_violations(spark, sf_dir):
    read(spark, sf_dir, "lineitem")[0].createOrReplaceTempView("lineitem_raw")
    dirty = spark.sql(_DIRTY.replace("FROM lineitem", "FROM lineitem_raw"))
    return dirty.filter("s <> q * p or s is null or p is null or q is null or s <= 0 or p <= 0 or q <= 0").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top10_rows(spark, sf_dir):
    return rel.top(read(spark, sf_dir, "orders")[0].select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


# --- graph ----------------------------------------------------------------------------------------------------------

_RAW_EDGES = """SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events"""
_EDGES = f"e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({_RAW_EDGES}) WHERE dst IS NOT NULL AND src <> dst)"
_V = "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
_START = "(SELECT min(src) FROM e)"


def _edges(spark, sf_dir):
    """Steps between users that follow each other. The next event is found by its place, not in one sorted task."""
    (events,) = read(spark, sf_dir, "events")
    placed = rel.numbered(events.select("ts", "event_id", "user_id"), ["ts", "event_id"], "at")
    after = placed.select((F.col("at") - 1).alias("at"), F.col("user_id").alias("dst"))
    found = placed.join(after, "at").select(F.col("user_id").alias("src"), "dst")
    return materialize(found, "transitions")


def _graph(spark, sf_dir, directed=True):
    return gr.build(_edges(spark, sf_dir).filter("src <> dst"), directed)


def _start(graph):
    return graph.edges.agg(F.min("src")).first()[0]


@query(f"WITH {_EDGES} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e")
def graph_build_undirected(spark, sf_dir):
    return _graph(spark, sf_dir, False).edges


@query(f"WITH {_EDGES} SELECT src, dst FROM e")
def graph_build_directed(spark, sf_dir):
    return _graph(spark, sf_dir).edges


@query(f"WITH {_EDGES}, {_V} SELECT id, (SELECT count(*) FROM e WHERE src = id) AS out_degree, (SELECT count(*) FROM e WHERE dst = id) AS in_degree FROM v")
def graph_degrees(spark, sf_dir):
    return _graph(spark, sf_dir).degrees()


@query(f"WITH {_EDGES}, {_V} SELECT u AS id, u IN (SELECT id FROM v) AS found FROM (SELECT user_id AS u FROM events UNION SELECT user_id + 1000000 FROM events)")
def node_lookup(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    users = read(spark, sf_dir, "events")[0].select(F.explode(F.array(F.col("user_id"), F.col("user_id") + 1_000_000)).alias("id")).distinct()
    return users.join(graph.vertices.withColumn("hit", F.lit(True)), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("found"))


@query(f"WITH {_EDGES} SELECT u, v, EXISTS (SELECT 1 FROM e WHERE src = u AND dst = v) AS found FROM (SELECT u, (u * 7) % 50 AS v FROM range(0, 200) t(u) UNION SELECT src, dst FROM e)")
def edge_lookup_batch(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    asked = spark.range(200).select(F.col("id").alias("u"), (F.col("id") * 7 % 50).alias("v"))
    return graph.has_edges(asked.union(graph.edges).distinct())


@query(f"WITH {_EDGES} SELECT src AS id, array_to_string(list_sort(list(dst)), ',') AS neighbours FROM e GROUP BY src")
def neighbors(spark, sf_dir):
    return _graph(spark, sf_dir).adjacency().select("id", F.array_join("neighbours", ",").alias("neighbours"))


@query(f"WITH {_EDGES} SELECT id, array_to_string(list_sort(list(n)), ',') AS neighbours FROM (SELECT src AS id, dst AS n FROM e UNION SELECT dst, src FROM e) GROUP BY id")
def neighbors_both(spark, sf_dir):
    return _graph(spark, sf_dir).adjacency("both").select("id", F.array_join("neighbours", ",").alias("neighbours"))


def _walk(steps, depth=1 << 30):
    """WITH clause up to w(distance, found): the nodes of each level, and all found up to it; a level is what the last one's steps add."""
    return f"""WITH RECURSIVE {_EDGES}, s AS MATERIALIZED (SELECT src, list(dst) AS near FROM ({steps}) GROUP BY src),
 w AS (SELECT 0 AS distance, [{_START}] AS level, [{_START}] AS found
  UNION ALL SELECT distance + 1, new, list_concat(found, new) FROM (SELECT w.distance, any_value(w.found) AS found, list_filter(list_distinct(flatten(list(s.near))), lambda x: NOT list_contains(any_value(w.found), x)) AS new
   FROM (SELECT distance, found, unnest(level) AS id FROM w WHERE distance < {depth}) w JOIN s ON s.src = w.id GROUP BY w.distance) WHERE len(new) > 0)"""


def _reach(steps, depth=1 << 30):
    return _walk(steps, depth) + " SELECT unnest(level) AS id, distance::INTEGER AS distance FROM w"


@query(_reach("SELECT src, dst FROM e"))
def bfs_distance(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return gr.bfs_distance(graph, _start(graph))


@query(_reach("SELECT src, dst FROM e", 2))
def bfs_depth2(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return gr.bfs_distance(graph, _start(graph), max_depth=2)


@query(_reach("SELECT src, dst FROM e UNION SELECT dst, src FROM e"))
def bfs_both(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return gr.bfs_distance(graph, _start(graph), direction="both")


#: Joins instead of one task, whatever the size.
JOINED = 0


@query(_reach("SELECT src, dst FROM e"))
def bfs_distance_by_joins(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return gr.bfs_distance(graph, _start(graph), one_task=JOINED)


_BOTH = "SELECT src, dst FROM e UNION SELECT dst, src FROM e"
_ORDER = f"""WITH RECURSIVE {_EDGES}, s AS MATERIALIZED ({_BOTH}),
 w AS (SELECT 0 AS distance, [{_START}] AS level, [{_START}] AS found
  UNION ALL SELECT distance + 1, new, list_concat(found, new) FROM (SELECT any_value(distance) AS distance, any_value(found) AS found, list(id ORDER BY pos, id) AS new FROM (
   SELECT x.distance, x.found, s.dst AS id, min(x.pos) AS pos FROM (SELECT distance, found, unnest(level) AS node, unnest(range(len(level))) AS pos FROM w) x JOIN s ON s.src = x.node
   WHERE NOT list_contains(x.found, s.dst) GROUP BY ALL)) WHERE new IS NOT NULL),
 o AS (SELECT unnest(level) AS id, distance::INTEGER AS distance, (len(found) - len(level) + unnest(range(len(level))))::BIGINT AS ord FROM w)"""


@query(_ORDER + " SELECT id, distance, ord FROM o")
def bfs_order_by_joins(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return gr.bfs(graph, _start(graph), direction="both", one_task=JOINED).select("id", "distance", "ord")


@query(_ORDER + " SELECT id, distance, ord FROM o")
def bfs_order(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return gr.bfs(graph, _start(graph), direction="both").select("id", "distance", "ord")


@query(_ORDER + """, f AS (SELECT o.id, arg_min(p.id, p.ord) AS parent FROM o JOIN s ON s.dst = o.id JOIN o p ON p.id = s.src AND p.distance = o.distance - 1 GROUP BY o.id),
 path AS (SELECT (SELECT max(dst) FROM s) AS id UNION ALL SELECT f.parent FROM path JOIN f USING (id)) SELECT distance::BIGINT AS step, id FROM path JOIN o USING (id)""")
def shortest_path_nodes(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    end = graph.vertices.agg(F.max("id")).first()[0]
    path = gr.shortest_path(graph, _start(graph), end, "both") or []
    return spark.createDataFrame(list(enumerate(path)), "step long, id long")


@query(f"""WITH RECURSIVE {_EDGES}, s AS MATERIALIZED (SELECT src, list(dst) AS near FROM ({_BOTH}) GROUP BY src),
 w AS (SELECT [{_START}] AS path, [{_START}] AS seen UNION ALL
  SELECT CASE WHEN ahead IS NULL THEN path[:-2] ELSE list_append(path, ahead) END, CASE WHEN ahead IS NULL THEN seen ELSE list_append(seen, ahead) END
  FROM (SELECT path, seen, list_min(list_filter(near, lambda x: NOT list_contains(seen, x))) AS ahead FROM w LEFT JOIN s ON s.src = path[len(path)] WHERE len(path) > 0))
 SELECT unnest(seen) AS id, unnest(range(len(seen))) AS ord FROM w WHERE len(path) = 0""")
def dfs_preorder(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return gr.dfs(graph, _start(graph), "both")


def _rank_sql(rounds):
    sql = f"WITH {_EDGES}, {_V}, n AS (SELECT count(*)::DOUBLE AS n FROM v), d AS (SELECT src, count(*) AS deg FROM e GROUP BY src), r0 AS (SELECT id, 1.0 / n AS s FROM v, n)"
    for i in range(1, rounds + 1):
        sql += f""", r{i} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (SELECT coalesce(sum(s), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM d)) / n + 0.85 * coalesce(g, 0) AS s FROM n, v
 LEFT JOIN (SELECT e.dst AS id, sum(s / deg) AS g FROM e JOIN r{i - 1} r ON r.id = e.src JOIN d ON d.src = e.src GROUP BY e.dst) USING (id))"""
    return sql


@query(_rank_sql(10) + " SELECT id, round(s, 8) AS score FROM r10")
def pagerank_10_iterations(spark, sf_dir):
    return gr.pagerank(_graph(spark, sf_dir), tol=1e-300, max_iter=10).scores.select("id", F.round("score", 8).alias("score"))


@query(_rank_sql(10) + " SELECT id, round(s, 8) AS score FROM r10")
def pagerank_by_joins(spark, sf_dir):
    ranks = gr.pagerank(_graph(spark, sf_dir), tol=1e-300, max_iter=10, one_task=JOINED)
    return ranks.scores.select("id", F.round("score", 8).alias("score"))


@query(_rank_sql(10) + " SELECT row_number() OVER (ORDER BY round(s, 8) DESC, id)::INTEGER AS place, id, round(s, 8) AS score FROM r10 QUALIFY place <= 10")
def pagerank_topk(spark, sf_dir):
    scores = gr.pagerank(_graph(spark, sf_dir), tol=1e-300, max_iter=10).scores.select("id", F.round("score", 8).alias("score"))
    best = rel.top(scores, [F.desc("score"), F.asc("id")], 10)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("place"), "id", "score")


_CLOSE = """WITH RECURSIVE {e}, {v}, s AS ({steps}), r AS (SELECT id, id AS reached FROM v UNION SELECT r.id, s.dst FROM r JOIN s ON s.src = r.reached)"""
_WCC = _CLOSE.format(e=_EDGES, v=_V, steps="SELECT src, dst FROM e UNION SELECT dst, src FROM e") + ", c AS (SELECT id, min(reached) AS component FROM r GROUP BY id)"
_SCC = _CLOSE.format(e=_EDGES, v=_V, steps="SELECT src, dst FROM e") + ", c AS (SELECT a.id, min(a.reached) AS component FROM r a JOIN r b ON a.id = b.reached AND a.reached = b.id GROUP BY a.id)"


@query(_WCC + " SELECT id, component FROM c")
def wcc_labels(spark, sf_dir):
    return gr.weak_components(_graph(spark, sf_dir))


@query(_WCC + " SELECT id, component FROM c")
def wcc_by_joins(spark, sf_dir):
    return gr.weak_components(_graph(spark, sf_dir), one_task=JOINED)


@query(_SCC + " SELECT id, component FROM c")
def scc_by_joins(spark, sf_dir):
    return gr.strong_components(_graph(spark, sf_dir), one_task=JOINED)


@query(f"WITH {_EDGES}, {_V}, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM v) SELECT a.n AS src, b.n AS dst FROM e JOIN i a ON a.id = src JOIN i b ON b.id = dst")
def graph_dense_index(spark, sf_dir):
    return _graph(spark, sf_dir).dense()


@query(_reach("SELECT src, dst FROM e").replace("SELECT unnest(level) AS id, distance::INTEGER AS distance FROM w", "SELECT sum(len(level))::BIGINT AS nodes, max(distance)::INTEGER AS depth FROM w"))
def bfs_reach(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return gr.reach(gr.bfs_distance(graph, _start(graph)))


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey % 13 <> 0 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)")
def key_difference(spark, sf_dir):
    lines, part = read(spark, sf_dir, "lineitem", "part")
    return rel.difference(lines.filter("l_partkey % 13 <> 0").select(F.col("l_partkey").alias("k")), part.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("k")), ["k"])


@query("SELECT l_orderkey, l_linenumber, date_diff('second', CAST(l_shipdate AS TIMESTAMP), CAST(l_shipdate AS TIMESTAMP) + INTERVAL 90 MINUTE + to_days(CAST(l_linenumber AS INTEGER))) AS seconds FROM lineitem")
def elapsed_seconds(spark, sf_dir):
    (lines,) = read(spark, sf_dir, "lineitem")
    start = F.to_timestamp("l_shipdate")
    end = start + F.make_dt_interval(F.col("l_linenumber").cast("int"), F.lit(0), F.lit(90))
    return lines.select("l_orderkey", "l_linenumber", tx.elapsed(start, end, "SECOND").alias("seconds"))


@query("SELECT event_id, json_extract_string(j, '$.kind') AS kind, CAST(json_extract(j, '$.n') AS BIGINT) AS n FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE '{\"kind\": \"' || event_type || '\", \"n\": ' || user_id || '}' END AS j FROM events)")
def json_decode(spark, sf_dir):
    (events,) = read(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 10 != 0, F.format_string('{"kind": "%s", "n": %d}', "event_type", "user_id"))
    return events.select("event_id", tx.read_json(text, "kind string, n long").alias("j")).select("event_id", "j.kind", "j.n")


@query(_WCC + " SELECT component, count(*) AS size FROM c GROUP BY component")
def wcc_sizes(spark, sf_dir):
    return gr.sizes(gr.weak_components(_graph(spark, sf_dir)))


@query(_SCC + " SELECT id, component FROM c")
def scc_labels(spark, sf_dir):
    return gr.strong_components(_graph(spark, sf_dir))


@query(_SCC + " SELECT component, count(*) AS size FROM c GROUP BY component")
def scc_sizes(spark, sf_dir):
    return gr.sizes(gr.strong_components(_graph(spark, sf_dir)))


@query(_WCC + ", z AS (SELECT component, count(*) AS size FROM c GROUP BY component) SELECT component, size, (SELECT count(*) FROM z) AS components, round(100 * size / (SELECT count(*) FROM v), 1) AS percent FROM z ORDER BY size DESC, component LIMIT 1")
def largest_component(spark, sf_dir):
    return gr.largest(gr.weak_components(_graph(spark, sf_dir)))


# --- transcripts ----------------------------------------------------------------------------------------------------

_MARKS = r"trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace({c}, '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '\[[^\]\n]{{1,40}}\]', ' ', 'g'), '^\s*>>+\s*', ''), '♪♫', '  '), '[\s\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{3000}}]+', ' ', 'g'))"


@query("SELECT doc_id, " + _MARKS.format(c="coalesce(text, '')") + " AS clean FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '>> [Music] ♪ ' || text ELSE text END AS text FROM documents)")
def clean_text_native(spark, sf_dir):
    (docs,) = read(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(">> [Music] ♪ "), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", tx.clean_marks(F.coalesce(t, F.lit(""))).alias("clean"))


@query()
def clean_text_full(spark, sf_dir):
    (pages,) = read(spark, sf_dir, "pages")
    return pages.select("page_id", tx.clean_text(F.col("html")).alias("clean"))


def _segments(spark, sf_dir):
    (turns,) = read(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seg"), "text", (F.col("turn") * 7.5).alias("start"))


_SEGMENTS = "s AS (SELECT conv_id AS video_id, turn AS seg, " + _MARKS.format(c="coalesce(text, '')") + " AS text, turn * 7.5::DOUBLE AS start FROM conversations)"
_OFFSETS = f"{_SEGMENTS}, o AS (SELECT video_id, seg, text, start, coalesce(sum(length(text) + 1) OVER (PARTITION BY video_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM s WHERE text <> '')"


@query(f"WITH {_OFFSETS} SELECT video_id, md5(string_agg(text, ' ' ORDER BY seg)) AS text_md5, max(pos) AS last_pos FROM o GROUP BY video_id")
def assemble_offsets(spark, sf_dir):
    marks = rt.offsets(_segments(spark, sf_dir), ["video_id"])
    return rt.assemble(marks, ["video_id"]).select("video_id", F.md5("text").alias("text_md5"), "last_pos")


@query()
def chunk_documents(spark, sf_dir):
    return rt.chunks(read(spark, sf_dir, "documents")[0], ["doc_id"])


@query(f"""WITH {_OFFSETS}, l AS (SELECT video_id, max(pos) AS m FROM o GROUP BY video_id), q AS (SELECT video_id, unnest(range(0, m + 1, 90)) AS start_index FROM l)
SELECT q.video_id, q.start_index, o.start AS start_seconds, printf('%02d:%02d', (o.start::BIGINT_CAST // 60) % 60, o.start::BIGINT_CAST % 60) AS timestamp FROM q ASOF JOIN o ON q.video_id = o.video_id AND q.start_index >= o.pos""".replace("o.start::BIGINT_CAST", "floor(o.start)::BIGINT"))
def asof_chunk_time(spark, sf_dir):
    marks = rt.offsets(_segments(spark, sf_dir), ["video_id"])
    ends = marks.groupBy("video_id").agg(F.max("pos").alias("m"))
    asked = ends.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"), F.lit(90).cast("long"))).alias("start_index"))
    return rt.time_chunks(asked, marks, ["video_id"])


@query("""
WITH c AS (SELECT doc_id // 10 AS video_id, doc_id AS pos, lang || CASE WHEN doc_id % 2 = 0 THEN '-XX' ELSE '' END AS language_code, doc_id % 3 = 0 AS is_generated, doc_id % 4 = 0 AS is_translatable FROM documents),
r AS (SELECT *, CASE split_part(lower(language_code), '-', 1) WHEN 'fr' THEN 0 WHEN 'de' THEN 1 END AS k FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY k NULLS LAST, is_generated, pos) AS n FROM r)
SELECT video_id, pos, language_code, CASE WHEN k IS NULL AND is_translatable THEN 'en' END AS translate_to FROM b WHERE n = 1""")
def transcript_selection(spark, sf_dir):
    (docs,) = read(spark, sf_dir, "documents")
    dash = F.when(F.col("doc_id") % 2 == 0, "-XX").otherwise("")
    candidates = docs.select(
        F.expr("doc_id div 10").alias("video_id"),
        F.col("doc_id").alias("pos"),
        F.concat("lang", dash).alias("language_code"),
        (F.col("doc_id") % 3 == 0).alias("is_generated"),
        (F.col("doc_id") % 4 == 0).alias("is_translatable"),
        F.array(F.lit("EN"), F.lit("pt")).alias("translations"),
    )
    return rt.select_transcript(candidates, ["fr", "de"]).select("video_id", "pos", "language_code", "translate_to")


@query("SELECT page_id, CASE WHEN page_id % 4 < 3 THEN lpad(CAST(page_id AS VARCHAR), 11, 'a') END AS video_id FROM pages")
def parse_url_ids(spark, sf_dir):
    (pages,) = read(spark, sf_dir, "pages")
    own = F.lpad(F.col("page_id").cast("string"), 11, "a")
    k = F.col("page_id") % 4
    link = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), own, F.lit("&t=5"))).when(k == 1, F.concat(F.lit("youtu.be/"), own)).when(k == 2, own).otherwise(F.col("url"))
    return pages.select("page_id", tx.video_id(link).alias("video_id"))


_NEAR = "SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id)::INTEGER AS rank, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings e"


def _asked(spark, sf_dir):
    """The stated query set: every vector whose id is divisible by 50, against all."""
    (vectors,) = read(spark, sf_dir, "embeddings")
    return vectors, vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity FROM ({_NEAR}) WHERE rank <= 20")
def knn_top20(spark, sf_dir):
    return rt.nearest(*_asked(spark, sf_dir), 20).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT query_id, rank, vec_id FROM ({_NEAR}) WHERE rank <= 4")
def knn_topk(spark, sf_dir):
    return rt.nearest(*_asked(spark, sf_dir), 4).drop("similarity")


def _mmr_sql(k=4, lam=0.5):
    """One common table expression a pick: the candidate with the best balance of likeness to the question and to the picks so far, the nearer among equals."""
    like = "list_cosine_similarity(a.v, b.v)"
    sql = f"""WITH n AS MATERIALIZED (SELECT n.*, e.embedding::DOUBLE[] AS v FROM ({_NEAR}) n JOIN embeddings e USING (vec_id) WHERE rank <= 20),
 m AS MATERIALIZED (SELECT a.query_id, a.vec_id, b.vec_id AS other, {like} AS near FROM n a JOIN n b USING (query_id)),
 p1 AS (SELECT query_id, 1 AS pick, vec_id FROM n WHERE rank = 1)"""
    for i in range(2, k + 1):
        sql += f""", p{i} AS MATERIALIZED (SELECT * FROM p{i - 1} UNION ALL SELECT query_id, {i}, vec_id FROM (
  SELECT n.query_id, n.vec_id, row_number() OVER (PARTITION BY n.query_id ORDER BY round({lam}::DOUBLE * any_value(n.similarity) - {1 - lam}::DOUBLE * max(m.near), 12) DESC, any_value(n.rank)) AS place
  FROM n JOIN m ON m.query_id = n.query_id AND m.vec_id = n.vec_id JOIN p{i - 1} p ON p.query_id = n.query_id AND p.vec_id = m.other
  WHERE NOT EXISTS (SELECT 1 FROM p{i - 1} q WHERE q.query_id = n.query_id AND q.vec_id = n.vec_id) GROUP BY n.query_id, n.vec_id) WHERE place = 1)"""
    return sql + f" SELECT query_id, pick, vec_id FROM p{k}"


@query(_mmr_sql())
def mmr_top4(spark, sf_dir):
    return rt.diverse(*_asked(spark, sf_dir))


_PAIRS = """p AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS pair FROM conversations WHERE role IN ('user', 'assistant')),
l AS (SELECT conv_id, pair FROM p WHERE pair > 0 GROUP BY conv_id, pair HAVING bool_or(role = 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pair DESC) <= 4)"""


@query(f"WITH {_PAIRS} SELECT conv_id, md5(string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn)) AS history_md5 FROM p JOIN l USING (conv_id, pair) GROUP BY conv_id")
def history_last4(spark, sf_dir):
    return rt.history(read(spark, sf_dir, "conversations")[0], ["conv_id"]).select("conv_id", F.md5("history").alias("history_md5"))


@query("SELECT conv_id, md5(string_agg('[' || printf('%02d:%02d', (turn * 61) // 60, (turn * 61) % 60) || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS context_md5 FROM conversations GROUP BY conv_id")
def context_format(spark, sf_dir):
    (turns,) = read(spark, sf_dir, "conversations")
    docs = turns.select("conv_id", (F.col("turn") * 61).cast("double").alias("start_seconds"), F.col("turn").alias("chunk_id"), "text")
    return rt.context(docs, ["conv_id"]).select("conv_id", F.md5("context").alias("context_md5"))


@query("SELECT substr(sha1('v1|800|150|model'), 1, 10) AS fingerprint")
def cache_fingerprint(spark, sf_dir):
    return spark.range(1).select(tx.fingerprint(*[F.lit(x) for x in ("v1", "800", "150", "model")]).alias("fingerprint"))


# --- paging ---------------------------------------------------------------------------------------------------------

_TRACE = """t AS (SELECT event_id AS arrival, (user_id % 8)::INTEGER AS proc, CASE WHEN event_id % 100 < 70 THEN ((user_id % 8) * 7 + ((event_id // 100) % 6) * 11) % 64 ELSE (event_id * 31 + user_id) % 65 END AS page,
 CASE WHEN event_type IN ('purchase', 'signup') THEN 'WRITE' ELSE 'READ' END AS access FROM events)"""


def _trace(spark, sf_dir):
    (events,) = read(spark, sf_dir, "events")
    page = F.when(F.col("event_id") % 100 < 70, (F.col("user_id") % 8 * 7 + F.expr("event_id div 100") % 6 * 11) % 64).otherwise((F.col("event_id") * 31 + F.col("user_id")) % 65)
    write = F.when(F.col("event_type").isin("purchase", "signup"), "WRITE").otherwise("READ")
    return events.select(F.col("event_id").alias("arrival"), (F.col("user_id") % 8).cast("int").alias("proc"), (page * pg.PAGE_SIZE + F.col("event_id") % 4096).alias("vaddr"), write.alias("access"), F.col("event_id").alias("seq"))


@query(f"WITH {_TRACE} SELECT arrival, proc, page FROM t WHERE page < 0 OR page >= 64")
def segfault_filter(spark, sf_dir):
    return pg.segfaults(_trace(spark, sf_dir)).select("arrival", "proc", "page")


@query(f"WITH {_TRACE}, z AS (SELECT *, min(CASE WHEN page >= 64 THEN arrival END) OVER (PARTITION BY proc) AS stop FROM t) SELECT arrival, proc, page FROM z WHERE stop IS NULL OR arrival <= stop")
def truncate_after_segfault(spark, sf_dir):
    return pg.truncated(_trace(spark, sf_dir)).select("arrival", "proc", "page")


@query(f"""WITH {_TRACE}, a AS (SELECT arrival, proc, page, lag(arrival) OVER w AS before, lead(arrival) OVER w AS after FROM t WHERE page < 64 AND NOT (access = 'WRITE' AND page < 4) WINDOW w AS (PARTITION BY proc, page ORDER BY arrival))
SELECT x.arrival, x.proc, x.page, CASE WHEN x.before IS NOT NULL THEN count(y.arrival) END AS distance, x.before IS NULL OR count(y.arrival) >= 16 AS fault
FROM a x LEFT JOIN a y ON y.arrival > x.before AND y.arrival < x.arrival AND coalesce(y.after, 4611686018427387904) > x.arrival GROUP BY x.arrival, x.proc, x.page, x.before""")
def lru_stack_distance(spark, sf_dir):
    """All accesses in range but writes to read-only pages, which may be violations and touch nothing."""
    trace = pg.with_page(_trace(spark, sf_dir))
    return pg.stack_distance_faults(trace.filter((F.col("page") < pg.PAGES) & ~((F.col("access") == "WRITE") & (F.col("page") < pg.READ_ONLY_PAGES))))


@query()
def mmu_simulation(spark, sf_dir):
    return pg.simulate(_trace(spark, sf_dir))


@query()
def mmu_counters(spark, sf_dir):
    return pg.counters(pg.simulate(_trace(spark, sf_dir)))


@query(f"WITH {_TRACE} SELECT proc, count(*) AS accesses FROM t GROUP BY proc")
def accesses_per_worker(spark, sf_dir):
    return _trace(spark, sf_dir).groupBy("proc").agg(F.count("*").alias("accesses"))


@query("""
SELECT hour, n, (sum(n) OVER (ORDER BY hour))::BIGINT AS total, errors FROM (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)""")
def monitor_per_second(spark, sf_dir):
    (events,) = read(spark, sf_dir, "events")
    hours = events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    hours = hours.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n", "errors")
    # One row an hour, so the running total is over few rows.
    return hours.withColumn("total", F.sum("n").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)))


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(CASE WHEN i = least(n - 1, (95 * n) // 100) THEN value END) AS p95 FROM r GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    found = rp.timings(read(spark, sf_dir, "events")[0], "event_type", "value")
    return found.select("event_type", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "p95")
