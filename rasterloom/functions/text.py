"""Expressions that turn texts into feature vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def letter_shares(text: Column | str, letters: str) -> Column:
    """array<double>: of the given characters in a text (as they are written), the share of each; zeros where there is none, also for a null text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in letters]
    total = F.greatest(F.lit(1), reduce(lambda a, b: a + b, counts))
    return F.array(*(c / total for c in counts))
