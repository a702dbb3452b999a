"""Largest transfers and names of banks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.functions import scalar as S
from remitlens.operators.routing import with_amount
from remitlens.params import Params


def largest(tx: DataFrame) -> DataFrame:
    """Each source bank's largest transfer, the first of equal ones; partial maxima are merged after the shuffle.

    The order is by amount, then by the smaller ``tx_id``, in one struct, so ties never depend on partitioning.
    """
    rank = F.struct((-F.col("amount_paid")).alias("less"), "tx_id")
    return with_amount(tx).groupBy("from_bank").agg(F.min_by(F.struct("from_account", "amount_paid", "tx_id"), rank).alias("top")).select(
        "from_bank", F.col("top.from_account").alias("from_account"), F.col("top.amount_paid").alias("amount_paid"), F.col("top.tx_id").alias("tx_id")
    )


def names(accounts: DataFrame, which: str = "first") -> DataFrame:
    """One name for each bank, the first or the last by ``seq``."""
    pick = F.min_by if which == "first" else F.max_by
    return accounts.groupBy("bank_id").agg(pick("bank_name", "seq").alias("bank_name"))


def named(top: DataFrame, banks: DataFrame, p: Params) -> DataFrame:
    """The maxima with their banks' names; banks without a name get a label."""
    joined = top.join(banks, top["from_bank"] == banks["bank_id"], "left")
    return joined.select(top["from_bank"], "from_account", S.bank_label(banks["bank_name"], top["from_bank"], p.unknown_bank).alias("bank_name"), "amount_paid")
