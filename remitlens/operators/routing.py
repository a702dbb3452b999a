"""Filters, two-sided routing, projections and unions of transfers.

A null never matches, so it goes to the side of those that do not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens import schema
from remitlens.functions import scalar as S
from remitlens.params import Params, Period


def usd(tx: DataFrame, p: Params) -> DataFrame:
    """Transfers whose currency is exactly the dollar's name."""
    return tx.where(F.col("currency") == p.usd)


def of_formats(tx: DataFrame, p: Params) -> DataFrame:
    return tx.where(F.col("payment_format").isin(*p.formats))


def in_period(tx: DataFrame, period: Period) -> DataFrame:
    return tx.where(S.in_period(F.col("ts"), period))


def below(tx: DataFrame, amount: float) -> DataFrame:
    """Transfers of strictly less than the amount; NaN is no amount."""
    return tx.where(S.is_amount(F.col("amount_paid")) & (F.col("amount_paid") < amount))


def with_amount(tx: DataFrame) -> DataFrame:
    return tx.where(S.is_amount(F.col("amount_paid")))


def route(tx: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and all others; both read the same scan."""
    met = F.coalesce(condition, F.lit(False))
    return tx.where(met), tx.where(~met)


def split_periods(tx: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transfers of period 1, of period 2 and of neither."""
    first, rest = route(tx, S.in_period(F.col("ts"), p.period1))
    second, other = route(rest, S.in_period(F.col("ts"), p.period2))
    return first, second, other


def project(tx: DataFrame, keep: Sequence[str] = schema.MASK, without: Sequence[str] = ()) -> DataFrame:
    """The columns in both the mask and the frame, in the mask's order."""
    return tx.select(*(c for c in schema.MASK if c in keep and c in tx.columns and c not in without))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def both_ends(edges: DataFrame) -> DataFrame:
    """Each edge once under its source and once under its target."""
    ends = F.array(
        F.struct(F.lit("source").alias("side"), F.col("from_bank").alias("bank"), F.col("from_account").alias("account")),
        F.struct(F.lit("target").alias("side"), F.col("to_bank").alias("bank"), F.col("to_account").alias("account")),
    )
    return edges.withColumn("end", F.explode(ends)).select("end.side", "end.bank", "end.account", *edges.columns)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], fields: str) -> DataFrame:
    """A user's function of whole batches of rows, for what columns cannot express; batches reach it as Arrow."""
    return df.mapInArrow(lambda batches: map(function, batches), fields)


def counted(tx: DataFrame, condition: Column) -> DataFrame:
    """One row: how many rows were processed, matched and not matched."""
    met = F.coalesce(condition, F.lit(False))
    return tx.agg(
        F.count("*").alias("processed"),
        F.count_if(met).alias("matched"),
        F.count_if(~met).alias("not_matched"),
    )
