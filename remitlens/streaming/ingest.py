"""Incremental ingestion of transfers, and the queries that can follow it.

Files that arrive in a folder are appended once to a table, the bronze table.
Repeats, by ``tx_id``, are dropped within the watermark's delay, and offsets and
that state live in the checkpoint, so a restarted run adds nothing twice. Q1 is a
stream without state, Q2 and Q5 are streaming aggregates, and Q3 and Q4, which need
all of period 1 first, run in batch over the bronze table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from remitlens.operators import banks, rates, routing
from remitlens.params import Params
from remitlens.plans import queries
from remitlens.schema import ACCOUNTS_FILE, TRANSFERS, TRANSFERS_FILE
from remitlens.sources import files


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Transfers of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(TRANSFERS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _append_files(spark: SparkSession, folder: str, schema: T.StructType, name: str, tests, typed, table: str, checkpoint: str, discard: bool, files_per_batch: int) -> StreamingQuery:
    """Append the rows of CSV files as they arrive to a table, in a part for each batch, and stop.

    A batch that runs again after a failure replaces its part, so nothing is added twice. A bad row ends the
    stream before anything of its batch is written, or is left out with ``discard``. Rows are numbered by batch,
    then in file order.
    """
    stream = files.with_options(spark.readStream, schema).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    stream = stream.selectExpr("*", *files.PLACE, "_metadata.file_size AS _size")

    def add(batch: DataFrame, number: int) -> None:
        sizes = {r["_path"]: r["_size"] for r in batch.select("_path", "_size").distinct().collect()}  # at most files_per_batch
        rows = files.in_file_order(batch.drop("_size").selectExpr("*", files.ROW), sizes, "_nth")
        key = F.struct(F.lit(number).cast("long").alias("batch"), F.col("_nth").alias("row"))
        rows = files.checked(rows, tests(), discard).withColumn(name, key).drop("_nth")
        typed(rows).withColumn("nth", F.col(f"{name}.row")).drop(name).write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transfers_from_csv(spark: SparkSession, folder: str, table: str, checkpoint: str, discard: bool = False, files_per_batch: int = 64) -> StreamingQuery:
    """Append transfers of CSV files as they arrive to a table that ``arrived`` reads."""
    return _append_files(spark, folder, TRANSFERS_FILE, "tx_id", files.transfer_tests, files.typed_transfers, table, checkpoint, discard, files_per_batch)


def accounts_from_csv(spark: SparkSession, folder: str, table: str, checkpoint: str, discard: bool = False, files_per_batch: int = 64) -> StreamingQuery:
    """Append accounts of CSV files as they arrive to a table that ``arrived`` reads."""
    return _append_files(spark, folder, ACCOUNTS_FILE, "seq", files.account_tests, files.typed_accounts, table, checkpoint, discard, files_per_batch)


def arrived(spark: SparkSession, table: str, order: str = "tx_id") -> DataFrame:
    """A table of appended batches; its order, a struct of batch and row, stands where a file's rows have a number."""
    rows = spark.read.parquet(table)
    return rows.withColumn(order, F.struct("batch", "nth")).drop("batch", "nth")


def deduplicated(tx: DataFrame, late: str = "1 day") -> DataFrame:
    """Each ``tx_id`` once; rows later than the watermark's delay are dropped, as those of a closed session."""
    timed = tx.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    return timed.dropDuplicatesWithinWatermark(["tx_id"]).drop("event_time")


def to_bronze(tx: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to the bronze table, partitioned by day, and stop."""
    writer = tx.writeStream.format("parquet").partitionBy("tx_date").outputMode("append")
    return writer.option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bronze(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(TRANSFERS).parquet(table)


def small_transfers(tx: DataFrame, p: Params) -> DataFrame:
    """Q1 as an append-only stream."""
    return queries.small_transfers(tx, p)


def largest_per_bank(tx: DataFrame, p: Params) -> DataFrame:
    """Q2's maxima as a streaming aggregate; names are joined when it is read."""
    return banks.largest(routing.usd(tx, p))


def micro_transfers(tx: DataFrame, daily: DataFrame, p: Params) -> DataFrame:
    """Q5 as a streaming count over a join with a fixed table of rates by day (see ``daily_rates``)."""
    chosen = routing.with_amount(routing.of_formats(routing.in_period(tx, p.period1), p))
    return rates.micro_count(chosen, daily, p)


def daily_rates(quotes: DataFrame, p: Params) -> DataFrame:
    """The rates that hold on each day of period 1; the fixed side of the streaming join."""
    return rates.rates_of_period(quotes, p.period1, p.rates_as_of)


def run_complete(aggregate: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run a streaming aggregate over what has arrived; its result is the in-memory table ``name``."""
    writer = aggregate.writeStream.format("memory").queryName(name).outputMode("complete")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, transfers: str, accounts: str, quotes: DataFrame, p: Params, which: Iterable[str] = queries.FIVE) -> dict[str, DataFrame]:
    """The chosen queries over all that has arrived in the tables of transfers and of accounts.

    Q3 and Q4 need all of period 1 before their second input can be judged; the table holds both until then.
    """
    return queries.chosen(arrived(spark, transfers), arrived(spark, accounts, "seq"), quotes, p, which)
