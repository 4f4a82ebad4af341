"""Bounded, repeatable samples of rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_of(row: list[Column], share: Column | float, seed: int) -> Column:
    """True for about this share of the rows, by a hash of all of ``row``; the same ones on every run."""
    return F.pmod(F.xxhash64(*row, F.lit(seed)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * share


def bounded(df: DataFrame, rows: int, seed: int = 17) -> DataFrame:
    """At most ``rows`` rows (all, if there are no more), chosen by a hash of the whole row, so rows that
    share an id are chosen apart.  Rows alike in every column hash alike; of those that remain over the
    bound, the first in the hash's order stay."""
    total = df.count()
    if total <= rows:
        return df
    columns = [F.col(f"`{c}`") for c in df.columns]
    some = df.where(share_of(columns, rows / total, seed))
    return some.orderBy(F.xxhash64(*columns, F.lit(seed + 1)), *columns).limit(rows)
