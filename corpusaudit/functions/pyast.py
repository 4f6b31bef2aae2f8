"""Python syntax check and cyclomatic complexity, as one Arrow function over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYNTAX = T.StructType(
    [T.StructField("valid", T.BooleanType()), T.StructField("cyclomatic", T.IntegerType())]
)


def syntax(code: Column) -> Column:
    """struct(valid, cyclomatic); cyclomatic is null for a text that does not parse.

    The function is local, so that it travels to the executors by value and they need nothing
    installed but pyarrow. Beside a batch as it came, a worker holds one text at a time, and it returns what it has freed
    to the system, since workers outlive their tasks.
    """

    def measure(text: str | None) -> tuple[bool, int | None]:
        import ast
        import warnings

        if text is None:
            return False, None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False, None
        branches = (ast.If, ast.For, ast.AsyncFor, ast.While)
        total = 1
        for node in ast.walk(tree):
            if isinstance(node, branches):
                total += 1
            elif isinstance(node, ast.Try):
                total += len(node.handlers)
        return True, total

    def give_back() -> None:
        import ctypes

        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow

        for codes in batches:
            found = [measure(c.as_py()) for c in codes]
            valid = pyarrow.array([v for v, _ in found], pyarrow.bool_())
            cyclomatic = pyarrow.array([n for _, n in found], pyarrow.int32())
            del codes
            yield pyarrow.StructArray.from_arrays([valid, cyclomatic], names=["valid", "cyclomatic"])
            give_back()

    return F.arrow_udf(run, SYNTAX)(code)
