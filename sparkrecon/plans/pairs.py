"""Source and destination tables derived from the given tables.

A destination is its source with rows left out, values changed, values set to
null and rows added, all decided by the key. Money is decimal and dates are
text, so that values compare the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ADDED = 1_000_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)").alias(name)


def _day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", _money("o_totalprice"),
        _day("o_orderdate"), "o_orderpriority",
    )


def _mod(name: str, n: int) -> Column:
    return F.col(name) % n == 0


def orders_dst(src: DataFrame) -> DataFrame:
    k = "o_orderkey"
    price = F.when(_mod(k, 7), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    changed = src.where(~_mod(k, 11)).withColumns(
        {
            "o_orderstatus": F.when(_mod(k, 17), "X").otherwise(F.col("o_orderstatus")),
            "o_totalprice": price.cast("decimal(18,2)"),
            "o_orderpriority": F.when(~_mod(k, 19), F.col("o_orderpriority")),
        }
    )
    added = src.where(_mod(k, 13)).withColumn(k, F.col(k) + ADDED)
    return changed.unionByName(added)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", _money("l_quantity"),
        _money("l_extendedprice"), _money("l_discount"), _money("l_tax"),
        "l_returnflag", "l_linestatus", _day("l_shipdate"),
    )


def lineitem_dst(src: DataFrame) -> DataFrame:
    more = F.when(_mod("l_partkey", 5), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    changed = src.where((F.col("l_orderkey") + F.col("l_linenumber")) % 7 != 0).withColumn(
        "l_quantity", more.cast("decimal(18,2)")
    )
    added = src.where(_mod("l_orderkey", 13)).withColumn(
        "l_orderkey", F.col("l_orderkey") + ADDED
    )
    return changed.unionByName(added)


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", _money("c_acctbal"), "c_mktsegment"
    )


def customer_dst(src: DataFrame) -> DataFrame:
    k = "c_custkey"
    balance = F.when(_mod(k, 6), F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    changed = src.where(F.col(k) % 10 != 3).withColumns(
        {
            "c_acctbal": balance.cast("decimal(18,2)"),
            "c_mktsegment": F.when(~_mod(k, 15), F.col("c_mktsegment")),
        }
    )
    return changed.unionByName(src.where(_mod(k, 20)).withColumn(k, F.col(k) + ADDED))


def supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", "s_nationkey", _money("s_acctbal")
    )


def supplier_dst(src: DataFrame) -> DataFrame:
    k = "s_suppkey"
    name = F.when(_mod(k, 4), F.concat("s_name", F.lit(" Ltd"))).otherwise(F.col("s_name"))
    return src.where(~_mod(k, 9)).withColumn("s_name", name)


def nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", _money("p_retailprice")
    )


def part_dst(src: DataFrame) -> DataFrame:
    k = "p_partkey"
    return src.where(~_mod(k, 8)).withColumn(
        "p_size", F.when(_mod(k, 3), F.col("p_size") + 1).otherwise(F.col("p_size"))
    )


def typed_tables(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    sources = {
        "customer": customer, "nation": nation, "orders": orders, "part": part, "supplier": supplier,
    }
    changes = {
        "customer": customer_dst, "orders": orders_dst, "part": part_dst, "supplier": supplier_dst,
    }
    both = {}
    for name, read in sources.items():
        src = read(spark, sf_dir)
        both[name] = (src, changes[name](src) if name in changes else src)
    return both


KEYS = {
    "customer": "c_custkey",
    "nation": "n_nationkey",
    "orders": "o_orderkey",
    "part": "p_partkey",
    "supplier": "s_suppkey",
}
