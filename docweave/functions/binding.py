"""Names for values inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)
