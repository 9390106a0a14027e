"""Arrow functions for what native expressions lack: normal forms and long-lived state.  A null gives a null."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .expressions import col


def mapped(fn: Callable[[str], object], kind: str = "string") -> Callable[[str | Column], Column]:
    """A column function from a function of one text, called for batches."""

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else fn(t) for t in texts.array], index=texts.index, dtype=object)

    def column(text: str | Column) -> Column:
        ship(SparkSession.getActiveSession())
        return F.pandas_udf(batch, kind)(col(text))

    return column
