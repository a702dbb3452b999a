"""Averages of payment formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.operators.routing import with_amount

#: Formats up to which their averages are sent to every task.
BROADCAST_FORMATS = 10_000


def sums(tx: DataFrame) -> DataFrame:
    """Sum and number of amounts of each format."""
    return with_amount(tx).groupBy("payment_format").agg(F.sum("amount_paid").alias("total"), F.count("*").alias("n"))


def averages(tx: DataFrame) -> DataFrame:
    return with_amount(tx).groupBy("payment_format").agg(F.avg("amount_paid").alias("average"))


def bounded(average: DataFrame) -> DataFrame:
    """The averages, computed now and sent to every task if they are few, else as they are."""
    rows = average.limit(BROADCAST_FORMATS + 1).toArrow()
    return F.broadcast(average.sparkSession.createDataFrame(rows)) if rows.num_rows <= BROADCAST_FORMATS else average


def below_average(tx: DataFrame, average: DataFrame, share: float) -> DataFrame:
    """Transfers of less than ``share`` of their format's average; formats without one are dropped.

    With ``bounded`` averages the transfers are not shuffled by their few formats.
    """
    return with_amount(tx).join(average, "payment_format").where(F.col("amount_paid") < F.col("average") * F.lit(share))
