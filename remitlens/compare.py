"""Order-insensitive comparison of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Difference:
    """Rows, with repeats, that one side has and the other has not."""

    missing: int
    unexpected: int

    @property
    def equal(self) -> bool:
        return not self.missing and not self.unexpected


def compare(expected: DataFrame, found: DataFrame) -> Difference:
    """Compare as bags of rows of text, by position; a different number of columns is an error."""
    if len(expected.columns) != len(found.columns):
        raise ValueError(f"{len(expected.columns)} columns are expected, there are {len(found.columns)}")
    sides = [df.toDF(*(f"c{i}" for i in range(len(df.columns)))) for df in (expected, found)]
    a, b = (df.select(*(df[c].cast("string").alias(c) for c in df.columns)) for df in sides)
    return Difference(a.exceptAll(b).count(), b.exceptAll(a).count())
