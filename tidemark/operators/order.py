"""The order of ticks. Where a table has several ticks of one symbol and time, their sequence orders them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import SEQ

# More than there are sequence numbers.
_NUMBERS = Decimal(10**19)


def by_time(ticks: DataFrame) -> list[str]:
    """The columns that order ticks: their time, and their sequence where it is known."""
    return ["timestamp", SEQ] if SEQ in ticks.columns else ["timestamp"]


def moment(ticks: DataFrame, first_wins: bool = False) -> Column:
    """One value that orders ticks as :func:`by_time` does; with ``first_wins`` the greatest is the first of the latest.

    Time and sequence are one decimal: aggregates by a struct would sort, those by a decimal hash."""
    at = F.col("timestamp")
    if SEQ not in ticks.columns:
        return at
    seq = F.col(SEQ).cast("decimal(19,0)")
    return at.cast("decimal(19,0)") * F.lit(_NUMBERS) + (-seq if first_wins else seq)
