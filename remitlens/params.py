"""Business parameters and the switches between documented variants."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta

# Fixed value: the currency that conversion takes as it is, whatever the filters call the dollar.
BASE_CURRENCY = "US Dollar"

# Names of convertible currencies and their ISO codes; the base currency has none.
CURRENCY_CODES = {
    "Australian Dollar": "AUD",
    "Brazil Real": "BRL",
    "Canadian Dollar": "CAD",
    "Euro": "EUR",
    "Mexican Peso": "MXN",
    "Ruble": "RUB",
    "Rupee": "INR",
    "Saudi Riyal": "SAR",
    "Shekel": "ILS",
    "Swiss Franc": "CHF",
    "UK Pound": "GBP",
    "Yen": "JPY",
    "Yuan": "CNY",
}


@dataclass(frozen=True)
class Period:
    """Days ``first`` to ``last``, both included."""

    first: date
    last: date

    @classmethod
    def of(cls, first: int, last: int) -> Period:
        """From days as YYYYMMDD integers; unlike a plain integer range, impossible days are refused."""
        days = [datetime.strptime(str(d), "%Y%m%d").date() for d in (first, last)]
        if days[0] > days[1]:
            raise ValueError(f"a period cannot end ({last}) before it starts ({first})")
        return cls(*days)

    @property
    def end(self) -> date:
        """The first day after the period."""
        return self.last + timedelta(days=1)

    @property
    def days(self) -> list[int]:
        """Every day of the period as a YYYYMMDD integer."""
        return [int((self.first + timedelta(days=i)).strftime("%Y%m%d")) for i in range((self.end - self.first).days)]


def split_list(raw: str) -> tuple[str, ...]:
    """The parts of a list separated by commas, trimmed, without blank ones."""
    return tuple(part for part in map(str.strip, raw.split(",")) if part)


@dataclass(frozen=True)
class Params:
    """Everything that changes results. Defaults are those of the original data's months."""

    usd: str = "US Dollar"
    period1: Period = Period.of(20220901, 20220905)
    period2: Period = Period.of(20220906, 20220915)
    formats: tuple[str, ...] = ("Wire", "ACH")
    small_amount: float = 50.0
    share_of_average: float = 0.01
    suspicious_degree: int = 5
    min_intermediates: int = 5
    micro_amount: float = 1.0
    #: Which of several names of a bank counts: the first or the last in file order.
    bank_names: str = "first"
    unknown_bank: str = "UNKNOWN_"
    #: Rates of the latest earlier day (True) or of the transfer's own day alone (False).
    rates_as_of: bool = True
    #: Also require the target's in-degree before paths are built, where that cannot change results.
    prune_fan_in: bool = True

    def __post_init__(self):
        positive = ("small_amount", "share_of_average", "suspicious_degree", "min_intermediates", "micro_amount")
        for name in positive:
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        if self.bank_names not in ("first", "last"):
            raise ValueError("bank_names is first or last")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Params:
        """Parameters from environment variables; unset ones keep their defaults."""
        # Names of the variables.
        names = {
            "CURRENCY_USD": ("usd", str),
            "AMOUNT_THRESHOLD_USD": ("small_amount", float),
            "AMOUNT_THRESHOLD_PCT": ("share_of_average", float),
            "SUSPICIOUS_THRESHOLD": ("suspicious_degree", int),
            "MIN_INTERMEDIATES": ("min_intermediates", int),
            "MAX_CONVERTED_AMOUNT_USD": ("micro_amount", float),
            "PAYMENT_FORMATS": ("formats", split_list),
        }
        found = {field: kind(env[name]) for name, (field, kind) in names.items() if env.get(name)}
        made = replace(cls(), **found)
        for k in (1, 2):
            bounds = [env.get(f"PERIOD{k}_{side}") for side in ("START", "END")]
            if any(bounds):
                was = getattr(made, f"period{k}")
                days = [int(b or d.strftime("%Y%m%d")) for b, d in zip(bounds, (was.first, was.last), strict=True)]
                made = replace(made, **{f"period{k}": Period.of(*days)})
        return made
