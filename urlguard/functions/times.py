"""Instants as numbers, for columns with or without a time zone (the session is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(c: Column | str) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(column.cast("timestamp"))


def seconds(c: Column | str) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.unix_seconds(column.cast("timestamp"))
