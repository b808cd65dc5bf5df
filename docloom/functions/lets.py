"""Local names inside Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it under a name in ``body``.

    Lambda bodies get no common-subexpression elimination, so a value used
    several times there is bound through a one-element array.
    """
    return F.transform(F.array(value), body)[0]
