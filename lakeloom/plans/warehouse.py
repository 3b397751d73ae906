"""Business files to a star schema: raw tables, cleansed tables, views, checks."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import cleansing as cl
from lakeloom.operators.relational import latest, numbered, valid_until

#: Folder, file and columns by position.
FILES = {
    "crm_cust_info": ("source_crm/cust_info.csv", "cst_id int, cst_key string, cst_firstname string, cst_lastname string, cst_marital_status string, cst_gndr string, cst_create_date date"),
    "crm_prd_info": ("source_crm/prd_info.csv", "prd_id int, prd_key string, prd_nm string, prd_cost int, prd_line string, prd_start_dt date, prd_end_dt date"),
    "crm_sales_details": ("source_crm/sales_details.csv", "sls_ord_num string, sls_prd_key string, sls_cust_id int, sls_order_dt int, sls_ship_dt int, sls_due_dt int, sls_sales int, sls_quantity int, sls_price int"),
    "erp_cust_az12": ("source_erp/cust_az12.csv", "cid string, bdate date, gen string"),
    "erp_loc_a101": ("source_erp/loc_a101.csv", "cid string, cntry string"),
    "erp_px_cat_g1v2": ("source_erp/px_cat_g1v2.csv", "id string, cat string, subcat string, maintenance string"),
}


class StepFailed(RuntimeError):
    """Names the step that failed; the cause is attached."""


def read_raw(spark: SparkSession, data_path: str, name: str) -> DataFrame:
    """A file with a header line, bound by position; empty fields are null; a row that doesn't fit fails."""
    file, schema = FILES[name]
    return spark.read.csv(f"{data_path}/{file}", schema=schema, header=True, enforceSchema=True, nullValue="", mode="FAILFAST")


def customers(raw: DataFrame) -> DataFrame:
    """The newest row of each customer that has a key."""
    newest = latest(raw.filter(F.col("cst_id").isNotNull()), ["cst_id"], [F.col("cst_create_date").desc_nulls_last(), F.asc("cst_key"), F.asc("cst_firstname"), F.asc("cst_lastname")])
    return newest.select(
        "cst_id",
        F.trim("cst_key").alias("cst_key"),
        F.trim("cst_firstname").alias("cst_firstname"),
        F.trim("cst_lastname").alias("cst_lastname"),
        cl.decode(F.col("cst_marital_status"), cl.MARITAL).alias("cst_marital_status"),
        cl.decode(F.col("cst_gndr"), cl.GENDER).alias("cst_gndr"),
        "cst_create_date",
    )


def products(raw: DataFrame) -> DataFrame:
    """Versions of a product, each valid until the day before the next; the file's end dates aren't used."""
    ranged = valid_until(raw.drop("prd_end_dt"), ["prd_key"], "prd_start_dt", ["prd_id"], "prd_end_dt")
    return ranged.select(
        "prd_id",
        cl.category_of(F.col("prd_key")).alias("cat_id"),
        cl.product_of(F.col("prd_key")).alias("prd_key"),
        F.trim("prd_nm").alias("prd_nm"),
        F.coalesce("prd_cost", F.lit(0)).alias("prd_cost"),
        cl.decode(F.col("prd_line"), cl.PRODUCT_LINE).alias("prd_line"),
        "prd_start_dt",
        "prd_end_dt",
    )


def sales(raw: DataFrame) -> DataFrame:
    fixed = raw.withColumn("fixed", cl.repaired_sales(F.col("sls_sales"), F.col("sls_quantity"), F.col("sls_price")))
    return fixed.select(
        F.trim("sls_ord_num").alias("sls_ord_num"),
        F.trim("sls_prd_key").alias("sls_prd_key"),
        "sls_cust_id",
        *[cl.date_of(F.col(c)).alias(c) for c in ("sls_order_dt", "sls_ship_dt", "sls_due_dt")],
        F.col("fixed").alias("sls_sales"),
        "sls_quantity",
        cl.repaired_price(F.col("sls_price"), F.col("fixed"), F.col("sls_quantity")).cast("int").alias("sls_price"),
    )


def demographics(raw: DataFrame, as_of: date | None = None) -> DataFrame:
    return raw.select(cl.without_prefix(F.col("cid"), "NAS").alias("cid"), cl.not_after(F.col("bdate"), as_of).alias("bdate"), cl.decode(F.col("gen"), cl.GENDER_WORDS).alias("gen"))


def locations(raw: DataFrame) -> DataFrame:
    return raw.select(cl.without_dashes(F.col("cid")).alias("cid"), cl.country(F.col("cntry")).alias("cntry"))


def categories(raw: DataFrame) -> DataFrame:
    return raw.select(*[F.trim(c).alias(c) for c in ("id", "cat", "subcat", "maintenance")])


CLEANSED = {
    "crm_cust_info": customers,
    "crm_prd_info": products,
    "crm_sales_details": sales,
    "erp_cust_az12": demographics,
    "erp_loc_a101": locations,
    "erp_px_cat_g1v2": categories,
}


def dim_customers(crm: DataFrame, erp: DataFrame, place: DataFrame) -> DataFrame:
    joined = crm.join(erp, crm["cst_key"] == erp["cid"], "left").drop("cid").join(place, F.col("cst_key") == place["cid"], "left").drop("cid")
    gender = F.when(F.col("cst_gndr") != cl.NOT_AVAILABLE, F.col("cst_gndr")).otherwise(F.coalesce("gen", F.lit(cl.NOT_AVAILABLE)))
    rows = joined.select(
        F.col("cst_id").alias("customer_id"),
        F.col("cst_key").alias("customer_number"),
        F.col("cst_firstname").alias("first_name"),
        F.col("cst_lastname").alias("last_name"),
        F.coalesce("cntry", F.lit(cl.NOT_AVAILABLE)).alias("country"),
        F.col("cst_marital_status").alias("marital_status"),
        gender.alias("gender"),
        F.col("bdate").alias("birthdate"),
        F.col("cst_create_date").alias("create_date"),
    )
    return numbered(rows, ["customer_id"], "customer_key")


def dim_products(crm: DataFrame, cat: DataFrame) -> DataFrame:
    """Open versions only."""
    rows = crm.filter(F.col("prd_end_dt").isNull()).join(cat, crm["cat_id"] == cat["id"], "left")
    rows = rows.select(
        F.col("prd_id").alias("product_id"),
        F.col("prd_key").alias("product_number"),
        F.col("prd_nm").alias("product_name"),
        F.col("cat_id").alias("category_id"),
        F.col("cat").alias("category"),
        F.col("subcat").alias("subcategory"),
        "maintenance",
        F.col("prd_cost").alias("cost"),
        F.col("prd_line").alias("product_line"),
        F.col("prd_start_dt").alias("start_date"),
    )
    return numbered(rows, ["start_date", "product_number"], "product_key")


def fact_sales(lines: DataFrame, prd: DataFrame, cst: DataFrame) -> DataFrame:
    p = prd.select("product_key", F.col("product_number").alias("__p"))
    c = cst.select("customer_key", F.col("customer_id").alias("__c"))
    return lines.join(p, F.col("sls_prd_key") == F.col("__p"), "left").join(c, F.col("sls_cust_id") == F.col("__c"), "left").select(
        F.col("sls_ord_num").alias("order_number"),
        "product_key",
        "customer_key",
        F.col("sls_order_dt").alias("order_date"),
        F.col("sls_ship_dt").alias("shipping_date"),
        F.col("sls_due_dt").alias("due_date"),
        F.col("sls_sales").alias("sales_amount"),
        F.col("sls_quantity").alias("quantity"),
        F.col("sls_price").alias("price"),
    )


def checks(t: dict[str, DataFrame], as_of: date | None = None) -> dict[str, DataFrame]:
    """Rows that break a rule, by its name. t: the cleansed tables by name, and dim_customers, dim_products, fact_sales."""
    cst, prd, sls = t["crm_cust_info"], t["crm_prd_info"], t["crm_sales_details"]
    az, loc = t["erp_cust_az12"], t["erp_loc_a101"]
    dc, dp, fact = t["dim_customers"], t["dim_products"], t["fact_sales"]
    twice = lambda df, c: df.groupBy(c).count().filter("count > 1")
    today = F.lit(as_of) if as_of else F.current_date()
    known = sls.join(prd.select(F.col("prd_key").alias("sls_prd_key"), F.lit(True).alias("p")).distinct(), "sls_prd_key", "left").join(cst.select(F.col("cst_id").alias("sls_cust_id"), F.lit(True).alias("c")).distinct(), "sls_cust_id", "left")
    both = cst.join(az.select(F.col("cid").alias("cst_key"), F.lit(True).alias("a")).distinct(), "cst_key", "left").join(loc.select(F.col("cid").alias("cst_key"), F.lit(True).alias("l")).distinct(), "cst_key", "left")
    right = F.col("sls_quantity") * F.col("sls_price")
    amounts = ["sls_sales", "sls_quantity", "sls_price"]
    wrong = F.col("sls_sales") != right
    for c in amounts:
        wrong = wrong | F.col(c).isNull() | (F.col(c) <= 0)
    return {
        "customer_key_unique": cst.groupBy("cst_id").count().filter("count > 1 or cst_id is null"),
        "names_trimmed": cst.filter((F.col("cst_firstname") != F.trim("cst_firstname")) | (F.col("cst_lastname") != F.trim("cst_lastname"))),
        "version_id_unique": twice(prd, "prd_id"),
        "cost_not_negative": prd.filter(F.col("prd_cost").isNull() | (F.col("prd_cost") < 0)),
        "end_after_start": prd.filter(F.col("prd_end_dt") < F.col("prd_start_dt")),
        "one_open_version": prd.filter(F.col("prd_end_dt").isNull()).groupBy("prd_key").count().filter("count <> 1"),
        "order_before_ship_and_due": sls.filter((F.col("sls_order_dt") > F.col("sls_ship_dt")) | (F.col("sls_order_dt") > F.col("sls_due_dt"))),
        "amounts_agree": sls.filter(wrong),
        "no_orphan_sales": known.filter(F.col("p").isNull() | F.col("c").isNull()),
        "no_prefix_no_future": az.filter(F.col("cid").startswith("NAS") | (F.col("bdate") > today)),
        "no_dashes": loc.filter(F.col("cid").contains("-")),
        "customers_in_both": both.filter(F.col("a").isNull() | F.col("l").isNull()),
        "customer_surrogate_unique": twice(dc, "customer_key"),
        "product_surrogate_unique": twice(dp, "product_key"),
        "customer_business_key_unique": twice(dc, "customer_id"),
        "product_business_key_unique": twice(dp, "product_number"),
        "fact_has_dimensions": fact.filter(F.col("product_key").isNull() | F.col("customer_key").isNull()),
    }


def run_checks(t: dict[str, DataFrame], as_of: date | None = None) -> DataFrame:
    """(check, violations); none is wanted."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in checks(t, as_of).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def informational(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Distinct codes and row counts, to be looked at."""
    rows = None
    for name in ("dim_customers", "dim_products", "fact_sales"):
        one = t[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), "rows")
        rows = one if rows is None else rows.unionByName(one)
    return {
        "marital_and_gender": t["crm_cust_info"].select("cst_marital_status", "cst_gndr").distinct(),
        "genders": t["erp_cust_az12"].select("gen").distinct(),
        "countries": t["erp_loc_a101"].select("cntry").distinct().orderBy("cntry"),
        "row_counts": rows,
    }


def load(spark: SparkSession, data_path: str, prefix: str = "", as_of: date | None = None) -> DataFrame:
    """Databases bronze, silver, gold (after the prefix): each table is replaced. Returns (layer, dataset, rows, ms) and stops at the first step that fails."""
    progress = []
    names = {layer: f"{prefix}{layer}" for layer in ("bronze", "silver", "gold")}

    def save(layer: str, name: str, make: Callable[[], DataFrame]) -> None:
        began = time.perf_counter()
        try:
            make().write.mode("overwrite").format("parquet").saveAsTable(f"{names[layer]}.{name}")
            rows = spark.table(f"{names[layer]}.{name}").count()
        except Exception as e:
            raise StepFailed(f"{layer}.{name}") from e
        progress.append((layer, name, rows, int(1000 * (time.perf_counter() - began))))

    for db in names.values():
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    for name in FILES:
        save("bronze", name, lambda name=name: read_raw(spark, data_path, name))

    def cleansed(name: str) -> DataFrame:
        raw, clean = spark.table(f"{names['bronze']}.{name}"), CLEANSED[name]
        return (clean(raw, as_of) if clean is demographics else clean(raw)).withColumn("dwh_create_date", F.current_timestamp())

    for name in CLEANSED:
        save("silver", name, lambda name=name: cleansed(name))
    silver = {name: spark.table(f"{names['silver']}.{name}").drop("dwh_create_date") for name in FILES}
    save("gold", "dim_customers", lambda: dim_customers(silver["crm_cust_info"], silver["erp_cust_az12"], silver["erp_loc_a101"]))
    save("gold", "dim_products", lambda: dim_products(silver["crm_prd_info"], silver["erp_px_cat_g1v2"]))
    dims = [spark.table(f"{names['gold']}.{d}") for d in ("dim_products", "dim_customers")]
    # The fact is a view over the stored dimensions, so that it is always up to date with the cleansed sales.
    fact_sales(silver["crm_sales_details"], *dims).createOrReplaceTempView(f"{prefix}fact_sales")
    return spark.createDataFrame(progress, "layer string, dataset string, rows long, ms long")


def tables(spark: SparkSession, prefix: str = "") -> dict[str, DataFrame]:
    found = {name: spark.table(f"{prefix}silver.{name}").drop("dwh_create_date") for name in FILES}
    return found | {d: spark.table(f"{prefix}gold.{d}") for d in ("dim_customers", "dim_products")} | {"fact_sales": spark.table(f"{prefix}fact_sales")}
