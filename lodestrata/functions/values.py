"""Values that an expression uses many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value found once a row however often it is used: it is the only element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
