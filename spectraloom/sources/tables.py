"""Spectra views over relational tables: how analysis inputs are derived from parquet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spectra import Spectra


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def embedding_spectra(spark: SparkSession, folder: str) -> Spectra:
    """Embedding vectors read as 64-point spectra on a 400..1975 axis, with source metadata."""
    rows = table(spark, folder, "embeddings")
    df = rows.select(
        F.col("vec_id").alias("sample_index"),
        F.col("label").cast("string").alias("class_label"),
        F.concat(F.lit("S"), (F.col("vec_id") % 8).cast("string")).alias("site"),
        F.concat(F.lit("B"), (F.col("vec_id") % 5).cast("string")).alias("batch"),
        (F.col("vec_id") % 3).cast("string").alias("replicate"),
        F.col("embedding").cast("array<double>").alias("y"),
    )
    return Spectra(df, 400.0 + 25.0 * np.arange(64))


def order_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """One metadata row per order, with the customer's geography attached."""
    customers = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "n_name", "r_name")
    )
    return (
        table(spark, folder, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("sample_index"),
            "o_orderpriority",
            "o_orderstatus",
            "c_mktsegment",
            "n_name",
            "r_name",
            "o_totalprice",
            "o_orderdate",
        )
    )


def supplier_flag_spectra(spark: SparkSession, folder: str) -> Spectra:
    """Monthly revenue profile of every (supplier, return flag, line status); null where absent."""
    monthly = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", "l_returnflag", "l_linestatus", F.month("l_shipdate").alias("m"))
        .agg(F.sum("l_extendedprice").alias("v"))
        .groupBy("l_suppkey", "l_returnflag", "l_linestatus")
        .agg(F.map_from_entries(F.collect_list(F.struct("m", "v"))).alias("by_month"))
    )
    df = monthly.select(
        (
            F.col("l_suppkey") * 100
            + F.ascii("l_returnflag") % 10 * 10
            + F.ascii("l_linestatus") % 10
        )
        .cast("bigint")
        .alias("sample_index"),
        F.col("l_suppkey").cast("string").alias("batch"),
        F.concat("l_returnflag", "l_linestatus").alias("replicate"),
        F.transform(
            F.sequence(F.lit(1), F.lit(12)), lambda m: F.try_element_at("by_month", m)
        ).alias("y"),
    )
    return Spectra(df, np.arange(1.0, 13.0))


def supplier_spectra(spark: SparkSession, folder: str) -> Spectra:
    """Complete 12-month revenue profile per supplier."""
    monthly = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", F.month("l_shipdate").alias("m"))
        .agg(F.sum("l_extendedprice").alias("v"))
        .groupBy("l_suppkey")
        .agg(F.map_from_entries(F.collect_list(F.struct("m", "v"))).alias("by_month"))
    )
    df = monthly.select(
        F.col("l_suppkey").alias("sample_index"),
        F.transform(
            F.sequence(F.lit(1), F.lit(12)),
            lambda m: F.coalesce(F.try_element_at("by_month", m), F.lit(0.0)),
        ).alias("y"),
    )
    return Spectra(df, np.arange(1.0, 13.0))


def hourly_spectra(spark: SparkSession, folder: str) -> Spectra:
    """Hour-of-day event value profile per user; null where the user had no event."""
    hourly = (
        table(spark, folder, "events")
        .groupBy("user_id", F.hour("ts").alias("h"))
        .agg(F.sum("value").alias("v"))
        .groupBy("user_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("h", "v"))).alias("by_hour"))
    )
    df = hourly.select(
        F.col("user_id").alias("sample_index"),
        F.transform(
            F.sequence(F.lit(0), F.lit(23)), lambda h: F.try_element_at("by_hour", h)
        ).alias("y"),
    )
    return Spectra(df, np.arange(24.0))
