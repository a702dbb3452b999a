"""The five queries and the exploratory ones over transfers, accounts and rates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.functions import scalar as S
from remitlens.operators import banks, formats, graph, rates, routing
from remitlens.params import Params


def small_transfers(tx: DataFrame, p: Params) -> DataFrame:
    """Q1: dollar transfers of less than the small amount."""
    return routing.below(routing.usd(tx, p), p.small_amount).select(*graph.ENDS, S.money(F.col("amount_paid")).alias("amount_paid"))


def largest_per_bank(tx: DataFrame, accounts: DataFrame, p: Params) -> DataFrame:
    """Q2: each source bank's largest dollar transfer, its account and the bank's name."""
    top = banks.named(banks.largest(routing.usd(tx, p)), banks.names(accounts, p.bank_names), p)
    return top.select("from_bank", "from_account", "bank_name", S.money(F.col("amount_paid")).alias("amount_paid"))


def below_format_average(tx: DataFrame, p: Params) -> DataFrame:
    """Q3: dollar transfers of period 2 under a share of their format's average in period 1."""
    dollars = routing.usd(tx, p)
    average = formats.bounded(formats.averages(routing.in_period(dollars, p.period1)))
    found = formats.below_average(routing.in_period(dollars, p.period2), average, p.share_of_average)
    return found.select("from_bank", "from_account", S.money(F.col("amount_paid")).alias("amount_paid"))


def scatter_gather(tx: DataFrame, p: Params) -> DataFrame:
    """Q4: pairs of accounts that dollar transfers of period 1 link through enough intermediaries."""
    chosen = routing.in_period(routing.usd(tx, p), p.period1)
    return graph.scatter_gather(chosen, p.suspicious_degree, p.min_intermediates, p.prune_fan_in).select(*graph.ENDS)


def micro_transfers(tx: DataFrame, quotes: DataFrame, p: Params) -> DataFrame:
    """Q5: how many period 1 transfers of the given formats are worth less than the micro amount in dollars; one row."""
    chosen = routing.with_amount(routing.of_formats(routing.in_period(tx, p.period1), p))
    return rates.micro_count(chosen, rates.rates_of_period(quotes, p.period1, p.rates_as_of), p)


#: The five queries by the names of their results.
FIVE = ("q1", "q2", "q3", "q4", "q5")


def chosen(tx: DataFrame, accounts: DataFrame, quotes: DataFrame, p: Params, which: Iterable[str] = FIVE) -> dict[str, DataFrame]:
    """The results of the chosen ones of the five queries over one set of tables."""
    made = {
        "q1": lambda: small_transfers(tx, p),
        "q2": lambda: largest_per_bank(tx, accounts, p),
        "q3": lambda: below_format_average(tx, p),
        "q4": lambda: scatter_gather(tx, p),
        "q5": lambda: micro_transfers(tx, quotes, p),
    }
    unknown = sorted(set(which) - set(made))
    if unknown:
        raise ValueError(f"there are no queries {unknown}")
    return {name: made[name]() for name in made if name in set(which)}


def in_bank_order(df: DataFrame) -> DataFrame:
    """Q2's rows as they are shown, by bank."""
    return df.orderBy("from_bank")


def in_format_order(df: DataFrame) -> DataFrame:
    """Sums and averages as they are shown, by format."""
    return df.orderBy("payment_format")


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows; an order before it makes them defined."""
    return df.limit(n)


def timestamp_range(tx: DataFrame) -> DataFrame:
    """E1: first and last timestamp, as files write them."""
    text = F.date_format("ts", "yyyy/MM/dd HH:mm")
    return tx.agg(F.min(text).alias("min_ts"), F.max(text).alias("max_ts"))


def shared_accounts(tx: DataFrame) -> DataFrame:
    """E2: account numbers that occur in more than one bank, on either side."""
    sides = [tx.select(F.col(f"{s}_bank").alias("bank"), F.col(f"{s}_account").alias("account")) for s in ("from", "to")]
    owners = routing.union_all(sides).distinct()
    return owners.groupBy("account").agg(F.count("*").alias("banks")).where("banks > 1")


def size(df: DataFrame) -> DataFrame:
    """E3, E4, E5: the number of rows."""
    return df.agg(F.count("*").alias("n"))


def text_period(tx: DataFrame, first: str, last: str) -> DataFrame:
    """Transfers whose timestamp, as text, lies between two days as text.

    A text that goes on after the day sorts behind the day alone, so nothing of the last day is in.
    """
    return tx.where(F.date_format("ts", "yyyy/MM/dd HH:mm").between(first, last))


def fan_out_range(tx: DataFrame, more_than: int = 5, less_than: int = 10) -> DataFrame:
    """E6: all transfers of accounts whose number of distinct targets lies strictly between the bounds."""
    degree = graph.out_degree(graph.edges(tx)).where((F.col("degree") > more_than) & (F.col("degree") < less_than))
    wide = degree.select(F.col("bank").alias("from_bank"), F.col("account").alias("from_account"))
    return tx.join(wide, ["from_bank", "from_account"], "left_semi")
