"""Line projections. All of them are narrow: a file's lines never leave its partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions.text import (
    block_end,
    block_indents,
    count_of,
    has,
    indent_of,
    jre,
    let,
    py_strip,
    split_lines,
)

WHILE_TRUE = jre(r"while\s+True:")


def code_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no, line), 0-based; an empty text is one empty line."""
    return files.select("file_id", F.posexplode(split_lines(F.col("code"))).alias("line_no", "line"))


def line_context(files: DataFrame) -> DataFrame:
    """Every line with the three that follow it; null means past the end of the file."""
    lines = files.select("file_id", split_lines(F.col("code")).alias("lines"))
    shifted = [F.slice("lines", k + 1, F.size("lines")).alias(f"next{k}") for k in (1, 2, 3)]
    zipped = lines.select("file_id", F.arrays_zip(F.col("lines").alias("line"), *shifted).alias("z"))
    return zipped.select("file_id", F.posexplode("z").alias("line_no", "z")).select(
        "file_id", "line_no", "z.line", "z.next1", "z.next2", "z.next3"
    )


def line_indent(files: DataFrame) -> DataFrame:
    return code_lines(files).select("file_id", "line_no", indent_of(F.col("line")).alias("indent"))


def block_ends(files: DataFrame) -> DataFrame:
    """One row per ``while True:`` line with the last line of its block."""
    lines = files.filter(has(F.col("code"), "while")).select(
        "file_id", split_lines(F.col("code")).alias("lines")
    )
    parts = lines.select("file_id", "lines", block_indents(F.col("lines")).alias("indents"))
    found = F.transform(
        "lines",
        lambda line, i: F.when(
            has(line, "while") & line.rlike(WHILE_TRUE),
            F.struct(i.alias("line_no"), block_end(F.col("indents"), i).alias("end_line")),
        ),
    )
    return parts.select("file_id", F.inline(F.array_compact(found)))


def is_nested_loop(lines: Column, indents: Column, line: Column, i: Column) -> Column:
    """A ``for`` line, a deeper ``for`` in the next 9 lines, an append in the 4 after that."""
    n = F.size(lines)

    def inner(j: Column) -> Column:
        return (
            has(F.get(lines, j), "for ")
            & (F.get(indents, j) > F.get(indents, i))
            & F.exists(F.slice(lines, j + 2, 4), lambda later: has(later, ".append("))
        )

    return (
        has(line, "for ")
        & (i < n - 2)
        & F.startswith(py_strip(line), F.lit("for "))
        & F.exists(F.sequence(i + 1, F.least(i + 9, n - 1)), inner)
    )


def nested_loop_sites(files: DataFrame) -> DataFrame:
    """Lines where a nested loop with an append starts."""
    lines = files.filter(has(F.col("code"), ".append(")).select(
        "file_id", split_lines(F.col("code")).alias("lines")
    )
    parts = lines.select("file_id", "lines", block_indents(F.col("lines")).alias("indents"))
    found = F.transform(
        "lines",
        lambda line, i: F.when(is_nested_loop(F.col("lines"), F.col("indents"), line, i), i),
    )
    return parts.select("file_id", F.explode(F.array_compact(found)).alias("line_no"))


def loop_count(code: Column) -> Column:
    return count_of(code, "for ") + count_of(code, "while ")


def loop_counts(files: DataFrame) -> DataFrame:
    return files.select("file_id", loop_count(F.col("code")).alias("n_loops"))


def numbered(code: Column) -> Column:
    """Listing with 1-based numbers in a field of four."""
    return let(
        split_lines(code),
        lambda lines: F.array_join(
            F.transform(lines, lambda line, i: F.format_string("%4d: %s", i + 1, line)), "\n"
        ),
    )


def numbered_listing(files: DataFrame) -> DataFrame:
    return files.select("file_id", "path", numbered(F.col("code")).alias("listing"))
