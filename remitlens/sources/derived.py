"""Transfers, banks and rates derived from the star-schema tables, for tests and benchmarks."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.functions import scalar as S
from remitlens.params import Params, Period
from remitlens.sources.files import rates_of, write_transfers

#: Periods that the events fall into.
PARAMS = replace(Params(), period1=Period.of(20240101, 20240105), period2=Period.of(20240106, 20240115))

FOREIGN = ("Euro", "UK Pound", "Yen", "Yuan", "Rupee", "Bitcoin", "Mexican Peso", "Ruble")
FORMATS = {"purchase": "Wire", "click": "ACH", "view": "Cheque", "signup": "Credit Card", "error": "Reinvestment"}
RATE_DAYS = (20240101, 20240102, 20240104, 20240105)
RATE_OF = {"EUR": 0.91, "GBP": 0.79, "JPY": 145.0, "CNY": 7.1, "INR": 83.0, "MXN": 17.0, "RUB": 90.0}


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transfer for every event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    names = F.array(*map(F.lit, FOREIGN))
    foreign = F.element_at(names, (F.expr("event_id div 4") % len(FOREIGN) + 1).cast("int"))
    formats = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return events.select(
        F.col("event_id").alias("tx_id"),
        "ts",
        S.day_number(F.col("ts")).alias("tx_date"),
        (F.col("user_id") % 20).alias("from_bank"),
        F.concat(F.lit("A"), F.expr("user_id div 2").cast("string")).alias("from_account"),
        (k % 20).alias("to_bank"),
        F.concat(F.lit("A"), F.expr("cast(get_json_object(props, '$.k') as long) div 2").cast("string")).alias("to_account"),
        F.col("value").alias("amount_paid"),
        F.when(F.col("event_id") % 4 != 0, F.lit(PARAMS.usd)).otherwise(foreign).alias("currency"),
        formats[F.col("event_type")].alias("payment_format"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account, and so a bank's name, for most suppliers."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 7 <> 3")
    key = F.col("s_suppkey").cast("long")
    return supplier.select(key.alias("seq"), key.alias("bank_id"), F.col("s_name").alias("bank_name"))


def rates(spark: SparkSession) -> DataFrame:
    return rates_of(spark, [(day, quote, rate) for day in RATE_DAYS for quote, rate in RATE_OF.items()])


def as_files(spark: SparkSession, tx: DataFrame) -> str:
    """The transfers as CSV files, under the folder that the cluster shares; the files' path."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/transfers-{uuid.uuid4().hex}"
    write_transfers(tx, path)
    return path
