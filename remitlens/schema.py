"""Columns of the tables, as files have them and as queries see them."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING = T.StringType()

#: Transfers file, by position; everything is text until it has been validated.
TRANSFERS_FILE = T.StructType(
    [T.StructField(name, _STRING) for name in ("ts", "from_bank", "from_account", "to_bank", "to_account", "received", "received_currency", "amount_paid", "currency", "payment_format", "label")]
)
ACCOUNTS_FILE = T.StructType([T.StructField(name, _STRING) for name in ("bank_name", "bank_id", "account", "entity_id", "entity_name")])

#: Transfers as queries see them; ``tx_id`` is the order in the file.
TRANSFERS = "tx_id long, ts timestamp_ntz, tx_date int, from_bank long, from_account string, to_bank long, to_account string, amount_paid double, currency string, payment_format string"
ACCOUNTS = "seq long, bank_id long, bank_name string, account string, entity_id string, entity_name string"
RATES = "rate_date int, quote string, rate double"

#: The eight columns that a projection can keep.
MASK = ("tx_date", "from_bank", "from_account", "to_bank", "to_account", "amount_paid", "currency", "payment_format")
