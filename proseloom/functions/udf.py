"""Arrow-batched functions that are made when they are first used, as their types need a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(kind: str) -> Callable:
    """A decorator: a function of pandas series becomes a function of columns that returns `kind`."""

    def make(run: Callable) -> Callable[..., Column]:
        def call(*cols) -> Column:
            return F.pandas_udf(run, kind)(*cols)

        call.__doc__ = run.__doc__
        return call

    return make
