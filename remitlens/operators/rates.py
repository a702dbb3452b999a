"""Joins of transfers with daily exchange rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remitlens.functions import scalar as S
from remitlens.params import CURRENCY_CODES, Params, Period

#: Rows of daily rates, days times currencies, up to which they are sent to every task; days with rates that come to the driver.
BROADCAST_RATES, RATE_DAYS = 100_000, 20_000


def as_of_days(days: DataFrame, rates: DataFrame) -> DataFrame:
    """``tx_date`` to ``rate_date``: the latest day with rates that is not later, else the earliest that there is.

    The days with rates, a few hundred a year, become a constant that each asked day looks itself up in; were they
    more than RATE_DAYS, both sides would meet in one ordered pass over distinct days.
    """
    offered = rates.where(F.col("rate_date").isNotNull()).select("rate_date").distinct()
    known = sorted(r["rate_date"] for r in offered.limit(RATE_DAYS + 1).collect())
    if 0 < len(known) <= RATE_DAYS:
        past = F.array_max(F.filter(F.split(F.lit(",".join(map(str, known))), ",").cast("array<int>"), lambda x: x <= F.col("tx_date")))
        return days.where(F.col("tx_date").isNotNull()).select("tx_date").distinct().select("tx_date", F.coalesce(past, F.lit(known[0])).alias("rate_date"))
    line = days.select("tx_date").distinct().select(F.col("tx_date").alias("day"), F.lit(None).cast("int").alias("offer"))
    line = line.unionByName(offered.select(F.col("rate_date").alias("day"), F.col("rate_date").alias("offer")))
    line = line.groupBy("day").agg(F.max("offer").alias("offer"), F.count_if(F.col("offer").isNull()).alias("asked"))
    past = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    found = F.coalesce(F.last("offer", ignorenulls=True).over(past), F.first("offer", ignorenulls=True).over(future))
    line = line.withColumn("rate_date", found).where("asked > 0 and rate_date is not null")
    return line.select(F.col("day").alias("tx_date"), "rate_date")


def rates_for_days(days: DataFrame, rates: DataFrame, as_of: bool) -> DataFrame:
    """``tx_date``, ``quote``, ``rate`` for each day of a table that is asked for."""
    if as_of:
        return as_of_days(days, rates).join(rates, "rate_date").select("tx_date", "quote", "rate")
    return rates.select(F.col("rate_date").alias("tx_date"), "quote", "rate")


def rates_of_period(rates: DataFrame, period: Period, as_of: bool) -> DataFrame:
    """``tx_date``, ``quote``, ``rate`` for each day of the period, which no table of transfers is read for.

    ``rates`` has one row a day and quote, so one task reads it. Every row is offered to each day of the
    period, which keeps those of the latest day that is not later, else of the earliest.
    """
    known = rates.where(F.col("quote").isin(*CURRENCY_CODES.values())).coalesce(1)
    if not as_of:
        return known.where(F.col("rate_date").isin(*period.days)).select(F.col("rate_date").alias("tx_date"), "quote", "rate")
    offered = known.select("*", F.explode(F.array(*map(F.lit, period.days))).alias("tx_date"))
    choice = F.when(F.col("rate_date") <= F.col("tx_date"), F.col("rate_date")).otherwise(-F.col("rate_date"))
    best = F.max("choice").over(Window.partitionBy("tx_date"))
    return offered.withColumn("choice", choice).withColumn("best", best).where("choice = best").select("tx_date", "quote", "rate")


def converted(tx: DataFrame, daily: DataFrame, days: int) -> DataFrame:
    """Transfers with their worth ``usd`` in dollars by the daily rates of so many days; null where it is unknown.

    The rates are at most days times currencies many, so where the days are bounded the transfers are not shuffled.
    """
    daily = F.broadcast(daily) if days * len(CURRENCY_CODES) <= BROADCAST_RATES else daily
    rated = tx.withColumn("quote", S.quote_of(F.col("currency"))).join(daily, ["tx_date", "quote"], "left")
    worth = F.when(S.is_base(F.col("currency")), F.col("amount_paid")).otherwise(S.in_dollars(F.col("amount_paid"), F.col("rate")))
    return rated.withColumn("usd", worth)


def micro_count(tx: DataFrame, daily: DataFrame, p: Params) -> DataFrame:
    """One row: how many of the transfers are worth less than the micro amount."""
    return converted(tx, daily, len(p.period1.days)).agg(F.count_if(F.col("usd") < p.micro_amount).alias("count"))


def latest(rates: DataFrame, *order: str) -> DataFrame:
    """One rate for each day and quote: the last that was given."""
    return rates.groupBy("rate_date", "quote").agg(F.max_by("rate", F.struct(*order)).alias("rate"))
