"""Checks of vector columns shared by the embedding operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_usable(vector: Column) -> Column:
    """Whether a vector is not null or empty, has finite components only and is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))
