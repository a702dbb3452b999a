"""The registered queries over the derived tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens import schema
from remitlens.functions import scalar as S
from remitlens.operators import banks, formats, graph, rates, routing
from remitlens.plans import queries as Q
from remitlens.sources import derived, files

P = derived.PARAMS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CTES = {
    "tx": """tx AS (
  SELECT event_id AS tx_id, ts, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS tx_date,
         user_id % 20 AS from_bank, 'A' || (user_id // 2) AS from_account,
         CAST(json_extract(props, '$.k') AS BIGINT) % 20 AS to_bank,
         'A' || (CAST(json_extract(props, '$.k') AS BIGINT) // 2) AS to_account,
         value AS amount_paid,
         CASE WHEN event_id % 4 <> 0 THEN 'US Dollar' ELSE
           ['Euro', 'UK Pound', 'Yen', 'Yuan', 'Rupee', 'Bitcoin', 'Mexican Peso', 'Ruble'][CAST((event_id // 4) % 8 + 1 AS INTEGER)] END AS currency,
         CASE event_type WHEN 'purchase' THEN 'Wire' WHEN 'click' THEN 'ACH' WHEN 'view' THEN 'Cheque'
           WHEN 'signup' THEN 'Credit Card' WHEN 'error' THEN 'Reinvestment' END AS payment_format
  FROM events)""",
    "usd": "usd AS (SELECT * FROM tx WHERE currency = 'US Dollar')",
    "p1": "p1 AS (SELECT * FROM usd WHERE tx_date BETWEEN 20240101 AND 20240105)",
    "p2": "p2 AS (SELECT * FROM usd WHERE tx_date BETWEEN 20240106 AND 20240115)",
    "banks": "banks AS (SELECT CAST(s_suppkey AS BIGINT) AS bank_id, s_name AS bank_name FROM supplier WHERE s_suppkey % 7 <> 3)",
    "rates": """rates AS (
  SELECT rate_date, quote, rate
  FROM (VALUES (20240101), (20240102), (20240104), (20240105)) d(rate_date),
       (VALUES ('EUR', CAST(0.91 AS DOUBLE)), ('GBP', 0.79), ('JPY', 145.0), ('CNY', 7.1), ('INR', 83.0), ('MXN', 17.0), ('RUB', 90.0)) q(quote, rate))""",
    "dim": """dim AS (SELECT * FROM (VALUES ('Euro', 'EUR'), ('UK Pound', 'GBP'), ('Yen', 'JPY'), ('Yuan', 'CNY'), ('Rupee', 'INR'), ('Mexican Peso', 'MXN'), ('Ruble', 'RUB')) c(currency, quote))""",
    "days": """days AS (
  SELECT t.tx_date, coalesce((SELECT max(rate_date) FROM rates r WHERE r.rate_date <= t.tx_date), (SELECT min(rate_date) FROM rates)) AS rate_date
  FROM (SELECT DISTINCT tx_date FROM tx) t)""",
    "e": "e AS (SELECT DISTINCT from_bank, from_account, to_bank, to_account FROM p1)",
    "fo": "fo AS (SELECT from_bank, from_account FROM e GROUP BY ALL HAVING count(*) >= 5)",
    "fi": "fi AS (SELECT to_bank, to_account FROM e GROUP BY ALL HAVING count(*) >= 5)",
    "h1": "h1 AS (SELECT e.* FROM e SEMI JOIN fo USING (from_bank, from_account))",
    "h2": "h2 AS (SELECT e.* FROM e SEMI JOIN fi USING (to_bank, to_account))",
    "paths": """paths AS (
  SELECT a.from_bank, a.from_account, a.to_bank AS mid_bank, a.to_account AS mid_account, b.to_bank, b.to_account
  FROM h1 a JOIN h2 b ON a.to_bank = b.from_bank AND a.to_account = b.from_account
  WHERE NOT (a.from_bank = b.to_bank AND a.from_account = b.to_account))""",
    "top": """top AS (
  SELECT from_bank, from_account, amount_paid, tx_id
  FROM (SELECT *, row_number() OVER (PARTITION BY from_bank ORDER BY amount_paid DESC, tx_id) AS nth FROM usd) WHERE nth = 1)""",
}
_NEEDS = {
    "usd": ["tx"], "p1": ["usd"], "p2": ["usd"], "days": ["tx", "rates"], "e": ["p1"], "fo": ["e"], "fi": ["e"],
    "h1": ["fo"], "h2": ["fi"], "paths": ["h1", "h2"], "top": ["usd"],
}


def _with(needs: str) -> str:
    """The common table expressions that the named ones build on, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    return "WITH " + ",\n".join(_CTES[n] for n in order) + "\n"


def _register(name: str, needs: str, sql: str):
    """Registers a function of (transfers, spark, sf_dir) under ``name`` with its SQL."""

    def wrap(f):
        QUERIES[name] = lambda spark, sf_dir: f(derived.transfers(spark, sf_dir), spark, sf_dir)
        ORACLES[name] = _with(needs) + sql
        return f

    return wrap


_TX = "tx_id, tx_date, from_bank, from_account, to_bank, to_account, amount_paid, currency, payment_format"
_PLAIN = _TX.split(", ")
_ENDS = "from_bank, from_account, to_bank, to_account"


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*_PLAIN)


def _edges(tx: DataFrame) -> DataFrame:
    return graph.edges(_first_dollars(tx))


def _first_dollars(tx: DataFrame) -> DataFrame:
    return routing.in_period(routing.usd(tx, P), P.period1)


# Scans and projections


@_register("scan_transactions", "tx", f"SELECT {_TX}, strftime(ts, '%Y/%m/%d %H:%M') AS ts FROM tx")
def _(tx, spark, sf_dir):
    return tx.select(*_PLAIN, F.date_format("ts", "yyyy/MM/dd HH:mm").alias("ts"))


@_register("scan_accounts", "banks", "SELECT bank_id, bank_name FROM banks")
def _(tx, spark, sf_dir):
    return derived.accounts(spark, sf_dir).select("bank_id", "bank_name")


@_register("rates_load", "rates", "SELECT rate_date, quote, rate FROM rates")
def _(tx, spark, sf_dir):
    return derived.rates(spark)


@_register("project_mask", "tx", "SELECT from_bank, from_account, to_bank, to_account, amount_paid, payment_format FROM tx")
def _(tx, spark, sf_dir):
    return routing.project(tx, schema.MASK, without=("currency", "tx_date"))


@_register("account_key", "tx", "SELECT tx_id, from_bank || '|' || from_account AS source, to_bank || '|' || to_account AS target FROM tx")
def _(tx, spark, sf_dir):
    key = lambda side: S.account_key(F.col(f"{side}_bank"), F.col(f"{side}_account"))
    return tx.select("tx_id", key("from").alias("source"), key("to").alias("target"))


# Filters, routing, unions


@_register("filter_usd", "usd", f"SELECT {_TX} FROM usd")
def _(tx, spark, sf_dir):
    return _plain(routing.usd(tx, P))


@_register("filter_wire_ach", "tx", f"SELECT {_TX} FROM tx WHERE payment_format IN ('Wire', 'ACH')")
def _(tx, spark, sf_dir):
    return _plain(routing.of_formats(tx, P))


@_register("filter_period1", "tx", f"SELECT {_TX} FROM tx WHERE tx_date BETWEEN 20240101 AND 20240105")
def _(tx, spark, sf_dir):
    return _plain(routing.in_period(tx, P.period1))


@_register("filter_period2", "tx", f"SELECT {_TX} FROM tx WHERE tx_date BETWEEN 20240106 AND 20240115")
def _(tx, spark, sf_dir):
    return _plain(routing.in_period(tx, P.period2))


@_register("filter_other_dates", "tx", f"SELECT {_TX} FROM tx WHERE NOT tx_date BETWEEN 20240101 AND 20240115")
def _(tx, spark, sf_dir):
    return _plain(routing.split_periods(tx, P)[2])


@_register("filter_route_match", "tx", "SELECT tx_id, from_bank, amount_paid FROM tx WHERE amount_paid < 50")
def _(tx, spark, sf_dir):
    return routing.route(tx, F.col("amount_paid") < P.small_amount)[0].select("tx_id", "from_bank", "amount_paid")


@_register("filter_route_nomatch", "tx", "SELECT tx_id, from_bank, amount_paid FROM tx WHERE NOT coalesce(amount_paid < 50, false)")
def _(tx, spark, sf_dir):
    return routing.route(tx, F.col("amount_paid") < P.small_amount)[1].select("tx_id", "from_bank", "amount_paid")


@_register(
    "split_periods", "tx",
    "SELECT CASE WHEN tx_date BETWEEN 20240101 AND 20240105 THEN 'period1' WHEN tx_date BETWEEN 20240106 AND 20240115 THEN 'period2' ELSE 'other' END AS branch, "
    "count(*) AS n, round(sum(amount_paid), 2) AS total FROM tx GROUP BY 1",
)
def _(tx, spark, sf_dir):
    parts = zip(("period1", "period2", "other"), routing.split_periods(tx, P), strict=True)
    rows = routing.union_all([part.withColumn("branch", F.lit(name)) for name, part in parts])
    return rows.groupBy("branch").agg(F.count("*").alias("n"), S.money(F.sum("amount_paid")).alias("total"))


@_register("union_usd_branches", "usd", f"SELECT {_TX} FROM usd")
def _(tx, spark, sf_dir):
    return _plain(routing.union_all([routing.usd(part, P) for part in routing.split_periods(tx, P)]))


@_register("filter_counts", "tx", "SELECT count(*) AS processed, count(*) FILTER (WHERE currency = 'US Dollar') AS matched, count(*) FILTER (WHERE currency <> 'US Dollar') AS not_matched FROM tx")
def _(tx, spark, sf_dir):
    return routing.counted(tx, F.col("currency") == P.usd)


# Q1 and Q2


@_register("q1_small_usd", "usd", f"SELECT {_ENDS}, round(amount_paid, 2) AS amount_paid FROM usd WHERE amount_paid < 50")
def _(tx, spark, sf_dir):
    return Q.small_transfers(tx, P)


@_register("bank_names", "banks", "SELECT bank_id, min_by(bank_name, bank_id) AS bank_name FROM banks GROUP BY bank_id")
def _(tx, spark, sf_dir):
    return banks.names(derived.accounts(spark, sf_dir), P.bank_names)


@_register("q2_partial_max", "top", "SELECT from_bank, from_account, amount_paid, tx_id FROM top")
def _(tx, spark, sf_dir):
    return banks.largest(routing.usd(tx, P))


@_register(
    "q2_max_per_bank", "top banks",
    "SELECT from_bank, from_account, coalesce(nullif(trim(bank_name), ''), 'UNKNOWN_' || from_bank) AS bank_name, round(amount_paid, 2) AS amount_paid FROM top LEFT JOIN banks ON from_bank = bank_id",
)
def _(tx, spark, sf_dir):
    return Q.largest_per_bank(tx, derived.accounts(spark, sf_dir), P)


@_register("q2_sorted", "top", "SELECT from_bank, from_account, amount_paid, tx_id FROM top ORDER BY from_bank")
def _(tx, spark, sf_dir):
    return Q.in_bank_order(banks.largest(routing.usd(tx, P)))


@_register(
    "q2_from_files", "top banks",
    "SELECT from_bank, from_account, coalesce(nullif(trim(bank_name), ''), 'UNKNOWN_' || from_bank) AS bank_name, round(amount_paid, 2) AS amount_paid FROM top LEFT JOIN banks ON from_bank = bank_id",
)
def _(tx, spark, sf_dir):
    """As ``q2_max_per_bank``, of transfers that were written as CSV files and read back in file order."""
    folder = derived.as_files(spark, tx)
    return Q.largest_per_bank(files.read_transfers(spark, folder), derived.accounts(spark, sf_dir), P)


@_register("e0_first_transfers", "tx", f"SELECT {_TX} FROM tx ORDER BY tx_id LIMIT 5")
def _(tx, spark, sf_dir):
    return Q.head(_plain(tx).orderBy("tx_id"))


@_register("q2_missing_names", "top banks", "SELECT count(*) AS n FROM top WHERE from_bank NOT IN (SELECT bank_id FROM banks)")
def _(tx, spark, sf_dir):
    named = banks.names(derived.accounts(spark, sf_dir)).withColumnRenamed("bank_id", "from_bank")
    return Q.size(banks.largest(routing.usd(tx, P)).join(named, "from_bank", "left_anti"))


# Q3


@_register("q3_sum_count", "p1", "SELECT payment_format, round(sum(amount_paid), 2) AS total, count(*) AS n FROM p1 GROUP BY payment_format")
def _(tx, spark, sf_dir):
    return formats.sums(routing.in_period(routing.usd(tx, P), P.period1)).withColumn("total", S.money(F.col("total")))


@_register("q3_format_avg", "p1", "SELECT payment_format, round(avg(amount_paid), 6) AS average FROM p1 GROUP BY payment_format")
def _(tx, spark, sf_dir):
    return formats.averages(routing.in_period(routing.usd(tx, P), P.period1)).withColumn("average", F.round("average", 6))


@_register(
    "q3_below_avg", "p1 p2",
    "SELECT p2.from_bank, p2.from_account, round(p2.amount_paid, 2) AS amount_paid FROM p2 JOIN (SELECT payment_format, avg(amount_paid) AS average FROM p1 GROUP BY payment_format) a "
    "USING (payment_format) WHERE p2.amount_paid < a.average * CAST(0.01 AS DOUBLE)",
)
def _(tx, spark, sf_dir):
    return Q.below_format_average(tx, P)


@_register("q3_sorted_sums", "p1", "SELECT payment_format, round(sum(amount_paid), 2) AS total, count(*) AS n FROM p1 GROUP BY payment_format ORDER BY payment_format")
def _(tx, spark, sf_dir):
    return Q.in_format_order(formats.sums(_first_dollars(tx)).withColumn("total", S.money(F.col("total"))))


# Q4


@_register("q4_edges", "e", f"SELECT {_ENDS} FROM e")
def _(tx, spark, sf_dir):
    return _edges(tx)


@_register(
    "q4_degree", "e",
    "SELECT bank, account, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT from_bank AS bank, from_account AS account, 1 AS o, 0 AS i FROM e "
    "UNION ALL SELECT to_bank, to_account, 0, 1 FROM e) GROUP BY bank, account",
)
def _(tx, spark, sf_dir):
    return graph.degrees(_edges(tx))


@_register(
    "q4_shard_both", "e",
    f"SELECT 'source' AS side, from_bank AS bank, from_account AS account, {_ENDS} FROM e UNION ALL SELECT 'target', to_bank, to_account, {_ENDS} FROM e",
)
def _(tx, spark, sf_dir):
    return routing.both_ends(_edges(tx))


@_register("q4_fanout_accounts", "fo", "SELECT from_bank AS bank, from_account AS account FROM fo")
def _(tx, spark, sf_dir):
    return graph.at_least(graph.out_degree(_edges(tx)), P.suspicious_degree)


@_register("q4_fanin_accounts", "fi", "SELECT to_bank AS bank, to_account AS account FROM fi")
def _(tx, spark, sf_dir):
    return graph.at_least(graph.in_degree(_edges(tx)), P.suspicious_degree)


@_register("q4_first_hop", "h1", f"SELECT {_ENDS} FROM h1")
def _(tx, spark, sf_dir):
    return graph.first_hops(_edges(tx), P.suspicious_degree)


@_register("q4_second_hop", "h2", f"SELECT {_ENDS} FROM h2")
def _(tx, spark, sf_dir):
    return graph.second_hops(_edges(tx), P.suspicious_degree)


@_register("q4_paths", "paths", "SELECT * FROM paths")
def _(tx, spark, sf_dir):
    e = _edges(tx)
    return graph.paths(graph.first_hops(e, P.suspicious_degree), graph.second_hops(e, P.suspicious_degree))


_PAIRS = f"SELECT {_ENDS}, count(*) AS intermediates FROM (SELECT DISTINCT * FROM paths) GROUP BY ALL HAVING count(*) >= 5"


@_register("q4_scatter_gather", "paths", f"SELECT {_ENDS} FROM ({_PAIRS})")
def _(tx, spark, sf_dir):
    return Q.scatter_gather(tx, P)


@_register("q4_sorted", "paths", f"SELECT {_ENDS}, intermediates FROM ({_PAIRS}) ORDER BY ALL")
def _(tx, spark, sf_dir):
    return graph.scatter_gather(_first_dollars(tx), P.suspicious_degree, P.min_intermediates).orderBy(*graph.ENDS)


# Q5


_Q5 = """SELECT count(*) AS count FROM tx LEFT JOIN dim USING (currency) {days}
LEFT JOIN rates ON rates.quote = dim.quote AND rates.rate_date = {day}
WHERE tx.tx_date BETWEEN 20240101 AND 20240105 AND payment_format IN ('Wire', 'ACH')
  AND CASE WHEN lower(tx.currency) = 'us dollar' THEN amount_paid WHEN rate <> 0 THEN amount_paid / rate END < 1"""


@_register("q5_micro_count", "days dim", _Q5.format(days="JOIN days ON days.tx_date = tx.tx_date", day="days.rate_date"))
def _(tx, spark, sf_dir):
    return Q.micro_transfers(tx, derived.rates(spark), P)


@_register("q5_micro_count_exact", "tx rates dim", _Q5.format(days="", day="tx.tx_date"))
def _(tx, spark, sf_dir):
    from dataclasses import replace

    return Q.micro_transfers(tx, derived.rates(spark), replace(P, rates_as_of=False))


@_register("rates_asof", "days rates", "SELECT days.tx_date, quote, rate FROM days JOIN rates USING (rate_date)")
def _(tx, spark, sf_dir):
    return rates.rates_for_days(tx, derived.rates(spark), as_of=True)


# Exploratory queries


@_register("e1_ts_range", "tx", "SELECT strftime(min(ts), '%Y/%m/%d %H:%M') AS min_ts, strftime(max(ts), '%Y/%m/%d %H:%M') AS max_ts FROM tx")
def _(tx, spark, sf_dir):
    return Q.timestamp_range(tx)


@_register(
    "e2_shared_accounts", "tx",
    "SELECT account, count(*) AS banks FROM (SELECT from_bank AS bank, from_account AS account FROM tx UNION SELECT to_bank, to_account FROM tx) GROUP BY account HAVING count(*) > 1",
)
def _(tx, spark, sf_dir):
    return Q.shared_accounts(tx)


@_register("e3_usd_count", "usd", "SELECT count(*) AS n FROM usd")
def _(tx, spark, sf_dir):
    return Q.size(routing.usd(tx, P))


@_register("e4_accounts_count", "banks", "SELECT count(*) AS n FROM banks")
def _(tx, spark, sf_dir):
    return Q.size(derived.accounts(spark, sf_dir))


_TEXT_PERIOD = "strftime(ts, '%Y/%m/%d %H:%M') BETWEEN '2024/01/01' AND '2024/01/06'"


@_register("e5_period_count", "usd", f"SELECT count(*) AS n FROM usd WHERE {_TEXT_PERIOD}")
def _(tx, spark, sf_dir):
    return Q.size(Q.text_period(routing.usd(tx, P), "2024/01/01", "2024/01/06"))


@_register(
    "e6_fanout_range", "usd",
    f"SELECT count(*) AS n FROM (SELECT * FROM usd WHERE {_TEXT_PERIOD}) u SEMI JOIN (SELECT from_bank, from_account FROM (SELECT DISTINCT {_ENDS} FROM usd WHERE {_TEXT_PERIOD}) "
    "GROUP BY ALL HAVING count(*) > 5 AND count(*) < 10) w USING (from_bank, from_account)",
)
def _(tx, spark, sf_dir):
    return Q.size(Q.fan_out_range(Q.text_period(routing.usd(tx, P), "2024/01/01", "2024/01/06")))
