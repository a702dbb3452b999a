"""A client's run of the queries: choose tables and queries, write all results, stop it from elsewhere.

All jobs of a run belong to the client's job group, so ``abort`` ends them wherever they stand; what a
result had not finished writing has no success mark. Rows that come after belong to no run.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from remitlens import compare
from remitlens.params import Params, split_list
from remitlens.plans import queries
from remitlens.sources import files


def run(
    spark: SparkSession, transfers: str, accounts: str, rates: DataFrame | str, folder: str, p: Params | None = None, which: Iterable[str] = queries.FIVE, client: str = "result"
) -> dict[str, str]:
    """Read a client's files, run the chosen queries and write a result for each; returns where they are."""
    p = p or Params.from_env()
    spark.sparkContext.setJobGroup(client, f"queries of {client}", interruptOnCancel=True)
    try:
        quotes = files.read_rates(spark, rates) if isinstance(rates, str) else rates
        made = queries.chosen(files.read_transfers(spark, transfers), files.read_accounts(spark, accounts), quotes, p, which)
        return files.write_results(made, folder, client)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def abort(spark: SparkSession, client: str) -> None:
    """Cancel a client's jobs, those that it would start later too."""
    spark.sparkContext.cancelJobGroup(client)


def generate(spark: SparkSession, dataset: str, root: str, rates: DataFrame | str, folder: str, which: Iterable[str] = queries.FIVE, p: Params | None = None) -> dict[str, str]:
    """Results of a named data set under ``root``, to compare later ones with."""
    transfers, accounts = files.datasets(root)[dataset]
    return run(spark, transfers, accounts, rates, folder, p, which, client="reference")


def differences(spark: SparkSession, folder: str, expected: str, which: Iterable[str] = queries.FIVE, client: str = "result", reference: str = "reference") -> dict[str, compare.Difference]:
    """How a client's written results differ from the reference's."""
    read = lambda at, name, q: spark.read.option("header", True).csv(f"{at.rstrip('/')}/{name}_{q}.csv")
    return {q: compare.compare(read(expected, reference, q), read(folder, client, q)) for q in which}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run the queries over the files of a data set and write their results.")
    parser.add_argument("--root", required=True, help="folder of the data sets")
    parser.add_argument("--dataset", default="small", choices=["small", "medium", "large"])
    parser.add_argument("--rates", required=True, help="JSON file of rates")
    parser.add_argument("--out", required=True, help="folder of the results")
    parser.add_argument("--queries", default="1,2,3,4,5")
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("remitlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    which = [f"q{n}" for n in split_list(asked.queries)]
    for query, path in generate(spark, asked.dataset, asked.root, asked.rates, asked.out, which).items():
        print(f"{query}: {path}")


if __name__ == "__main__":
    main()
