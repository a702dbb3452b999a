"""Dates, keys, amounts and currencies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from remitlens.params import BASE_CURRENCY, CURRENCY_CODES, Period


def day_number(ts: Column) -> Column:
    """YYYYMMDD as an integer."""
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def day_of_number(day: Column) -> Column:
    """The date of a YYYYMMDD integer; null if there is no such day."""
    return F.try_to_timestamp(day.cast("string"), F.lit("yyyyMMdd")).cast("date")


def iso_day(day: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD."""
    return F.date_format(day_of_number(day), "yyyy-MM-dd")


def in_period(ts: Column, period: Period) -> Column:
    """Half-open test on the timestamp itself, which reaches the Parquet scan."""
    low, high = (F.lit(d.isoformat()).cast("timestamp_ntz") for d in (period.first, period.end))
    return (ts >= low) & (ts < high)


def account_key(bank: Column, account: Column) -> Column:
    """Printable key of an account, which is unique only together with its bank."""
    return F.concat_ws("|", bank.cast("string"), account)


def is_amount(amount: Column) -> Column:
    """Neither null nor NaN: a NaN passes no test, but would be the largest amount."""
    return amount.isNotNull() & ~F.isnan(amount)


def money(amount: Column) -> Column:
    return F.round(amount, 2)


def money_text(amount: Column) -> Column:
    return F.format_string("%.2f", amount)


def quote_of(currency: Column) -> Column:
    """ISO code of a currency's name; null for the base currency and unknown names."""
    pairs = [F.lit(x) for pair in CURRENCY_CODES.items() for x in pair]
    return F.create_map(*pairs)[currency]


def is_base(currency: Column) -> Column:
    """Whether conversion leaves the currency as it is: the base currency, without regard to case."""
    return F.lower(currency) == F.lit(BASE_CURRENCY.lower())


def in_dollars(amount: Column, rate: Column) -> Column:
    """Units of a quote to dollars; null where there is no rate or it is zero."""
    return F.when(rate != 0, amount / rate)


def bank_label(name: Column, bank: Column, unknown: str) -> Column:
    """The bank's name, or a label with its number where it is missing or blank."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit(unknown), bank.cast("string")))
