"""Transfers, accounts and rates from files, and results to files.

Files have a header, whose content is ignored, and columns by position. One bad
row fails the read: validation covers every kept column, whether or not a query
uses it, which the reader's own FAILFAST mode does not do.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from pathlib import Path
from random import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitlens.functions import scalar as S
from remitlens.operators.rates import latest
from remitlens.schema import ACCOUNTS_FILE, RATES, TRANSFERS_FILE

_UNSIGNED = r"^[0-9]{1,10}$"
_MOST_ID = 2**32 - 1
_DAY_TIME = "yyyy/MM/dd HH:mm"
#: Files up to which a table of them is sent to every task.
BROADCAST_FILES = 10_000


class BadRows(ValueError):
    """A file has rows that cannot be read."""


def _wide(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])


def with_options(reader, schema: T.StructType):
    """A reader, of tables or of streams, of files with a header whose columns go by position.

    All columns are parsed, whichever a query uses, as their number is a test of each row.
    """
    reader = reader.schema(_wide(schema)).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", "_bad").option("columnPruning", False)


#: Where a row stands: its file and the start of the file's block that one task reads, as SQL.
PLACE = ("_metadata.file_path AS _path", "_metadata.file_block_start AS _block")
#: A row's number in its task, as SQL; the upper bits of Spark's number are the task's.
ROW = "monotonically_increasing_id() & 8589934591 AS _row"


def _step(spark: SparkSession) -> int:
    """A power of two of bytes that no two blocks of one file start within."""
    sizes = [spark.conf.get(f"spark.sql.files.{name}") for name in ("maxPartitionBytes", "openCostInBytes")]
    least = min(int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(s)) for s in sizes)
    return 1 << max(1, least).bit_length() - 1


def in_file_order(rows: DataFrame, sizes: dict[str, int], name: str) -> DataFrame:
    """``rows``, which have ``_path``, ``_block`` and ``_row``, with a unique number that grows along files in order of their paths.

    Spark orders the blocks that tasks read by size, so a row's number within its task says nothing across
    blocks. The number is made of the blocks before the row's own and of its number in the task. ``sizes`` has the
    bytes of every file, which the driver knows from listing them.
    """
    spark, step = rows.sparkSession, _step(rows.sparkSession)
    first, at = [], 0
    for path in sorted(sizes):
        first.append((path, at))
        at += sizes[path] // step + 1
    bits = 63 - at.bit_length()
    numbered = F.shiftleft(F.col("_first") + F.floor(F.col("_block") / step), bits) + F.col("_row")
    if len(first) == 1:
        rows = rows.withColumn("_first", F.lit(0).cast("long"))
    else:
        starts = spark.createDataFrame(first, "_path string, _first long")
        rows = rows.join(F.broadcast(starts) if len(first) <= BROADCAST_FILES else starts, "_path")
    return rows.withColumn(name, numbered).drop("_path", "_block", "_row", "_first")


def _sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """The bytes of every file of a file or folder, from its listing alone."""
    listed = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_size")
    return {r["file_path"]: r["file_size"] for r in listed.collect()}


def _read(spark: SparkSession, path: str, schema: T.StructType, name: str) -> DataFrame:
    """The file's columns, ``_bad`` and the row's number in file order."""
    raw = with_options(spark.read, schema).csv(path).selectExpr("*", *PLACE, ROW)
    return in_file_order(raw, _sizes(spark, path), name)


def _unsigned(name: str) -> Column:
    return F.col(name).rlike(_UNSIGNED) & (F.col(name).cast("long") <= _MOST_ID)


def transfer_tests() -> dict[str, Column]:
    """What every raw transfer has to meet."""
    return {
        "ts": F.try_to_timestamp("ts", F.lit(_DAY_TIME)).isNotNull(),
        "from_bank": _unsigned("from_bank"),
        "to_bank": _unsigned("to_bank"),
        "amount_paid": F.trim("amount_paid").try_cast("double").isNotNull(),
        **{c: F.col(c).isNotNull() for c in ("from_account", "to_account", "currency", "payment_format")},
    }


def account_tests() -> dict[str, Column]:
    return {"bank_id": _unsigned("bank_id"), "account": F.col("account").isNotNull()}


def _failed(tests: dict[str, Column]) -> Column:
    """Names of the tests that a row fails; empty if it passes all and has the right number of columns."""
    return F.concat_ws(", ", *(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items()), F.when(F.col("_bad").isNotNull(), F.lit("columns")))


def checked(df: DataFrame, tests: dict[str, Column], discard: bool = False) -> DataFrame:
    """Rows that pass every test. Others fail the read with BadRows, which shows some of them, or are left out with ``discard``."""
    if discard:
        return df.where(_failed(tests) == "")
    bad = df.withColumn("_failed", _failed(tests)).where("_failed <> ''").limit(5).collect()
    if bad:
        raise BadRows("; ".join(f"{r['_failed']}: {[r[c] for c in df.columns if c != '_bad']}" for r in bad))
    return df


def typed_transfers(raw: DataFrame) -> DataFrame:
    """Raw transfers with ``tx_id`` as queries see them."""
    ts = F.to_timestamp_ntz("ts", F.lit(_DAY_TIME))
    return raw.select(
        "tx_id",
        ts.alias("ts"),
        S.day_number(ts).alias("tx_date"),
        F.col("from_bank").cast("long").alias("from_bank"),
        "from_account",
        F.col("to_bank").cast("long").alias("to_bank"),
        "to_account",
        F.trim("amount_paid").try_cast("double").alias("amount_paid"),
        "currency",
        "payment_format",
    )


def typed_accounts(raw: DataFrame) -> DataFrame:
    """Raw accounts with ``seq`` as queries see them."""
    return raw.select("seq", F.col("bank_id").cast("long").alias("bank_id"), "bank_name", "account", "entity_id", "entity_name")


def read_transfers(spark: SparkSession, path: str, discard: bool = False) -> DataFrame:
    """The transfers of a file or folder; ``tx_id`` grows in file order, files in order of their paths."""
    return typed_transfers(checked(_read(spark, path, TRANSFERS_FILE, "tx_id"), transfer_tests(), discard))


def read_accounts(spark: SparkSession, path: str, discard: bool = False) -> DataFrame:
    """The accounts of a file or folder; ``seq`` grows in file order, files in order of their paths. Names may be blank."""
    return typed_accounts(checked(_read(spark, path, ACCOUNTS_FILE, "seq"), account_tests(), discard))


def write_transfers(tx: DataFrame, path: str) -> None:
    """Transfers as files that ``read_transfers`` reads, in order of ``tx_id`` across files."""
    head = [f.name for f in TRANSFERS_FILE.fields]
    made = tx.orderBy("tx_id").select(
        F.date_format("ts", _DAY_TIME).alias("ts"), "from_bank", "from_account", "to_bank", "to_account", F.col("amount_paid").alias("received"),
        F.col("currency").alias("received_currency"), "amount_paid", "currency", "payment_format", F.lit("0").alias("label"),
    )
    made.select(*head).write.mode("overwrite").option("header", True).csv(path)


def rates_table(raw: DataFrame) -> DataFrame:
    """``date`` (YYYY-MM-DD), ``quote``, ``rate`` to the rates that queries take.

    Rows whose date cannot be read are dropped; of repeated ones the last counts.
    """
    day = F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))
    rows = raw.select(S.day_number(day).alias("rate_date"), "quote", F.col("rate").cast("double").alias("rate"), F.monotonically_increasing_id().alias("seq"))
    return latest(rows.where("rate_date is not null"), "seq")


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Rates from a JSON file that holds a list of {date, quote, rate}."""
    return rates_table(spark.read.schema("date string, quote string, rate double").option("multiLine", True).json(path))


def fetch_rates(
    spark: SparkSession, api: str, first: str, last: str, base: str = "USD", tries: int = 5, wait: float = 0.5, get: Callable[[str], bytes] | None = None
) -> DataFrame:
    """Rates from an HTTP service; overload and network failures are retried with growing, jittered waits, other errors are final."""
    url = f"{api}/rates?from={first}&to={last}&base={base}"

    def load() -> bytes:
        with urllib.request.urlopen(url, timeout=30) as answer:
            return answer.read()

    for attempt in range(1, tries + 1):
        try:
            rows = json.loads((get or (lambda _: load()))(url))
            break
        except urllib.error.HTTPError as e:
            if attempt == tries or not (e.code == 429 or e.code >= 500):
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == tries:
                raise
        time.sleep(wait * 2 ** (attempt - 1) * (0.5 + random()))
    pairs = [(r["date"], r["quote"], float(r["rate"])) for r in rows]
    return rates_table(spark.createDataFrame(pairs, "date string, quote string, rate double"))


def rates_of(spark: SparkSession, rows: Iterable[tuple[int, str, float]]) -> DataFrame:
    """A table of (day, quote, rate) that is part of the plan, so no job reads it."""
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = (pa.int32(), pa.string(), pa.float64())
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["rate_date", "quote", "rate"]), RATES)


# The header of each query's result file.
HEADERS = {
    "q1": ["From Bank", "Account", "To Bank", "Account.1", "Amount Paid"],
    "q2": ["Bank ID", "Account", "Bank Name", "Amount Paid"],
    "q3": ["From Bank", "Account", "Amount Paid"],
    "q4": ["From Bank", "Account", "To Bank", "Account.1"],
    "q5": ["count"],
}


def write_result(df: DataFrame, folder: str, query: str, client: str = "result", one_file: bool = True) -> str:
    """Write a result as CSV under ``folder`` with amounts of two decimals; an empty result has its header alone.

    A result replaces an earlier one of its name and is complete once its success mark is there. One file
    suits results that people read; without it every partition writes its own.
    """
    made = df.withColumn("amount_paid", S.money_text(F.col("amount_paid"))) if "amount_paid" in df.columns else df
    made = made.toDF(*HEADERS[query])
    target = f"{folder.rstrip('/')}/{client}_{query}.csv"
    (made.coalesce(1) if one_file else made).write.mode("overwrite").option("header", True).csv(target)
    return target


def write_results(results: dict[str, DataFrame], folder: str, client: str = "result", one_file: bool = True) -> dict[str, str]:
    """Write the results of several queries; returns where each was written."""
    return {query: write_result(df, folder, query, client, one_file) for query, df in results.items()}


def datasets(root: str) -> dict[str, tuple[str, str]]:
    """Transfers and accounts files of the named sizes under a folder."""
    return {size.lower(): (str(Path(root) / f"LI-{size}_Trans.csv"), str(Path(root) / f"LI-{size}_accounts.csv")) for size in ("Small", "Medium", "Large")}
