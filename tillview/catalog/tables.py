"""The given test tables seen as sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.sources.session import input_bytes, widen_shuffles

ORDER_COLUMNS = {"order_ts", "phone"}
CUSTOMER_COLUMNS = {"customer_name", "name_check", "phone_status"}
PART_COLUMNS = {"brand", "product_group"}
SUPPLIER_COLUMNS = {"store", "region"}

EXPRESSIONS = {
    "order_ts": "o_orderdate",
    "doc_no": "cast(l_orderkey as string)",
    "phone": "cast(o_custkey as string)",
    "customer_name": "c_name",
    "name_check": "c_mktsegment",
    "phone_status": "case when c_acctbal < 0 then 'invalid' else 'valid' end",
    "gross": "cast(l_extendedprice as decimal(18,4))",
    "net": "cast(cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(3,2)) "
    "- cast(l_discount as decimal(3,2))) as decimal(18,4))",
    "doc_type": "l_returnflag",
    "brand": "p_brand",
    "region": "r_name",
    "store": "s_name",
    "product_group": "p_type",
    "product_code": "cast(l_partkey as string)",
    "quantity": "cast(l_quantity as decimal(18,4))",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(_path(sf_dir, name))


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def sales_table(spark: SparkSession, sf_dir: str, columns: str | None = None) -> DataFrame:
    """Receipt lines from the order tables, with the canonical ``columns`` asked for.

    Only the tables those columns come from are joined. Each join looks up a
    unique key, so no line is lost or repeated. Orders get their customers before
    the much larger line table is joined. Lines and orders both grow without
    bound, so they are merged by key, which also spreads the lines over all
    tasks; for the other tables the measured sizes decide. Shuffles get partitions
    in proportion to the tables read.
    """
    wanted = columns.split() if columns else list(EXPRESSIONS)
    need = set(wanted)

    paths = []

    def table(name: str) -> DataFrame:
        paths.append(_path(sf_dir, name))
        return read_table(spark, sf_dir, name)

    lines = table("lineitem")
    if need & (ORDER_COLUMNS | CUSTOMER_COLUMNS):
        orders = table("orders")
        if need & CUSTOMER_COLUMNS:
            orders = orders.join(table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        lines = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if need & PART_COLUMNS:
        lines = lines.join(table("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if need & SUPPLIER_COLUMNS:
        stores = table("supplier")
        if "region" in need:
            nations = table("nation").join(
                table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
            )
            stores = stores.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        lines = lines.join(stores, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    widen_shuffles(spark, input_bytes(spark, paths))
    return lines.select(*(F.expr(EXPRESSIONS[c]).alias(c) for c in wanted))


def event_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as sales, for times of day."""
    widen_shuffles(spark, input_bytes(spark, [_path(sf_dir, "events")]))
    return read_table(spark, sf_dir, "events").select(
        F.col("ts").alias("order_ts"),
        F.col("event_id").cast("string").alias("doc_no"),
        F.col("user_id").cast("string").alias("phone"),
        F.lit(None).cast("string").alias("customer_name"),
        F.col("event_type").alias("name_check"),
        F.lit(None).cast("string").alias("phone_status"),
        F.col("value").cast("decimal(18,4)").alias("gross"),
        F.col("value").cast("decimal(18,4)").alias("net"),
        F.col("event_type").alias("store"),
    )


#: Faults by remainders of keys: missing and padded values, gross of 0 and below, names that change.
DIRTY = {
    "phone": "if(cast(phone as bigint) % 11 = 0, null, phone)",
    "store": "case when cast(phone as bigint) % 13 = 0 then null "
    "when cast(doc_no as bigint) % 17 = 0 then concat(' ', store) else store end",
    "region": "case when cast(doc_no as bigint) % 7 = 0 then null "
    "when cast(doc_no as bigint) % 19 = 0 then concat(region, ' ') else region end",
    "gross": "cast(case when cast(doc_no as bigint) % 23 = 0 then 0 "
    "when cast(doc_no as bigint) % 5 = 0 then -gross else gross end as decimal(18,4))",
    "net": "cast(case when cast(doc_no as bigint) % 5 = 0 then -net else net end as decimal(18,4))",
    "customer_name": "case when cast(doc_no as bigint) % 3 = 0 then null "
    "when cast(doc_no as bigint) % 2 = 0 then concat(customer_name, '*') else customer_name end",
    "product_code": "if(cast(product_code as bigint) % 29 = 0, null, product_code)",
}


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines with the faults that real tables have."""
    sales = sales_table(spark, sf_dir)
    return sales.select(*(F.expr(DIRTY.get(c, c)).alias(c) for c in sales.columns))
