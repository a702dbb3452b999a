"""The graph of transfers between accounts.

An account is a pair of bank and number, never the number alone. Edges are
distinct, so a path through an intermediary occurs once and counting paths
counts distinct intermediaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENDS = ["from_bank", "from_account", "to_bank", "to_account"]


def edges(tx: DataFrame) -> DataFrame:
    return tx.select(*ENDS).distinct()


def _account(side: str) -> list:
    return [F.col(f"{side}_bank").alias("bank"), F.col(f"{side}_account").alias("account")]


def out_degree(e: DataFrame) -> DataFrame:
    """Accounts with the number of accounts that they send to."""
    return e.groupBy(*_account("from")).agg(F.count("*").alias("degree"))


def in_degree(e: DataFrame) -> DataFrame:
    """Accounts with the number of accounts that send to them."""
    return e.groupBy(*_account("to")).agg(F.count("*").alias("degree"))


def degrees(e: DataFrame) -> DataFrame:
    """Every account's out- and in-degree, from one pass over the edges' ends."""
    ends = F.array(
        F.struct(F.col("from_bank").alias("bank"), F.col("from_account").alias("account"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("to_bank").alias("bank"), F.col("to_account").alias("account"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    rows = e.select(F.explode(ends).alias("end")).select("end.*")
    return rows.groupBy("bank", "account").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def at_least(degree: DataFrame, threshold: int) -> DataFrame:
    return degree.where(F.col("degree") >= threshold).select("bank", "account")


def first_hops(e: DataFrame, threshold: int) -> DataFrame:
    """Edges that leave accounts with at least ``threshold`` targets."""
    wide = at_least(out_degree(e), threshold).toDF("from_bank", "from_account")
    return e.join(wide, ["from_bank", "from_account"], "left_semi").select(*ENDS)


def second_hops(e: DataFrame, threshold: int) -> DataFrame:
    """Edges that reach accounts with at least ``threshold`` sources."""
    wide = at_least(in_degree(e), threshold).toDF("to_bank", "to_account")
    return e.join(wide, ["to_bank", "to_account"], "left_semi").select(*ENDS)


#: Second hops of an intermediary that one group of the join holds; first hops of a wider one are dealt to several.
GROUP_EDGES = 4096
#: Wide intermediaries up to which a table of them is sent to every task.
BROADCAST_WIDE = 100_000


def paths(first: DataFrame, second: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """Two hops from one account to another; the middle may be either of them, the ends may not be the same.

    ``wide`` (``bank``, ``account``, ``degree``) has intermediaries with many second hops, which are cut into groups by
    their targets' hash, so no task joins all first hops of one with all its second hops.
    """
    a = first.toDF("from_bank", "from_account", "mid_bank", "mid_account")
    b = second.toDF("mid_bank", "mid_account", "to_bank", "to_account")
    apart = (F.col("from_bank") != F.col("to_bank")) | (F.col("from_account") != F.col("to_account"))
    keys = ["mid_bank", "mid_account"]
    if wide is not None:
        groups = F.ceil(F.col("degree") / GROUP_EDGES).cast("int").alias("groups")
        wide = wide.select(F.col("bank").alias("mid_bank"), F.col("account").alias("mid_account"), groups)
        n = F.coalesce("groups", F.lit(1))
        a = a.join(wide, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).drop("groups")
        b = b.join(wide, keys, "left").withColumn("part", F.pmod(F.xxhash64("to_bank", "to_account"), n).cast("int")).drop("groups")
        keys = [*keys, "part"]
    return a.join(b, keys).where(apart).select(*ENDS[:2], "mid_bank", "mid_account", *ENDS[2:])


def wide_accounts(tx: DataFrame) -> DataFrame | None:
    """Accounts that may have more targets than a group of a join holds, found now: None if there are none, sent to every task if few.

    Their degree is the number of their transfers, which bounds that of their targets and needs no distinct edges.
    """
    wide = out_degree(tx).where(F.col("degree") > GROUP_EDGES)
    rows = wide.limit(BROADCAST_WIDE + 1).toArrow()
    if rows.num_rows > BROADCAST_WIDE:
        return wide
    return F.broadcast(tx.sparkSession.createDataFrame(rows)) if rows.num_rows else None


def scatter_gather(tx: DataFrame, degree: int, intermediates: int, prune_fan_in: bool = True) -> DataFrame:
    """Pairs of accounts that transfers link through at least ``intermediates`` distinct others, with their number.

    Only sources of at least ``degree`` targets count. A target reached through that
    many intermediaries has as many sources, so where ``degree`` asks no more than
    ``intermediates``, second hops to narrower targets are dropped before the join.
    """
    prune = prune_fan_in and degree <= intermediates
    e = edges(tx)
    found = paths(first_hops(e, degree), second_hops(e, intermediates) if prune else e, wide_accounts(tx))
    counts = found.groupBy(*ENDS).agg(F.count("*").alias("intermediates"))
    return counts.where(F.col("intermediates") >= intermediates)
