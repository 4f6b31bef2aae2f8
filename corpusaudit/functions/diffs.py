"""Line diffs as Arrow functions. Equal texts are not sent to Python. The functions are local, so
that they travel to the executors by value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _if_changed(before: Column, after: Column) -> tuple[Column, Column]:
    changed = before != after
    return F.when(changed, before), F.when(changed, after)


def changed_lines(before: Column, after: Column) -> Column:
    """Lines that a line-by-line comparison marks as added or removed."""

    def count(a: str | None, b: str | None) -> int:
        import difflib

        if a is None or b is None:
            return 0
        marks = difflib.Differ().compare(a.split("\n"), b.split("\n"))
        return sum(mark[:2] in ("+ ", "- ") for mark in marks)

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        import pandas

        return pandas.Series([count(x, y) for x, y in zip(a, b)], dtype="int32")

    return F.pandas_udf(batch, T.IntegerType())(*_if_changed(before, after))


def unified_diff(before: Column, after: Column) -> Column:
    def diff(a: str | None, b: str | None) -> str:
        import difflib

        if a is None or b is None:
            return ""
        lines = difflib.unified_diff(
            a.splitlines(keepends=True),
            b.splitlines(keepends=True),
            fromfile="original",
            tofile="modified",
            lineterm="",
        )
        return "".join(lines)

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        import pandas

        return pandas.Series([diff(x, y) for x, y in zip(a, b)], dtype="object")

    return F.pandas_udf(batch, T.StringType())(*_if_changed(before, after))
