"""Changed lines from an edit script: which original line each line of the result is, or -1.

Lines that were kept part the script into hunks of removed and added lines. Within a hunk a line that
was removed and added again in order is unchanged; hunks hold no more than the edits put there, so
comparing them line by line is cheap whatever the length of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusaudit.functions.text import let


def _common(removed: Column, added: Column) -> Column:
    """Length of the longest common subsequence of two short arrays."""

    def next_row(row: Column, line: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            same = F.get(added, j) == line
            best = F.when(same, F.get(row, j) + 1).otherwise(F.greatest(F.get(row, j + 1), F.get(new, j)))
            return F.concat(new, F.array(best))

        places = F.sequence(F.lit(0), F.size(added) - 1)
        return F.aggregate(places, F.array(F.lit(0)), cell)

    start = F.array_repeat(F.lit(0), F.size(added) + 1)
    return F.element_at(F.aggregate(removed, start, next_row), -1)


def hunks(before: Column, after: Column, origin: Column) -> Column:
    """struct(removed, added): arrays of (at, line), where ``at`` is the number of kept lines before it.
    Lines with equal ``at`` are one hunk."""
    gone = F.array_except(F.transform(before, lambda _, i: i), origin)
    fresh = F.filter(
        F.transform(origin, lambda o, j: F.when(o < 0, F.struct(j.alias("j"), F.get(after, j).alias("line")))),
        lambda x: x.isNotNull(),
    )
    return F.struct(
        F.transform(gone, lambda i, k: F.struct((i - k).alias("at"), F.get(before, i).alias("line"))).alias("removed"),
        F.transform(fresh, lambda x, k: F.struct((x["j"] - k).alias("at"), x["line"].alias("line"))).alias("added"),
    )


def lines_changed(before: Column, after: Column, origin: Column) -> Column:
    """Lines removed and lines added, in order."""

    def count(h: Column) -> Column:
        shared = F.array_intersect(F.transform(h["removed"], lambda x: x["at"]), F.transform(h["added"], lambda x: x["at"]))

        def again(at: Column) -> Column:
            of = lambda side: F.transform(F.filter(side, lambda x: x["at"] == at), lambda x: x["line"])
            return _common(of(h["removed"]), of(h["added"]))

        kept = F.aggregate(shared, F.lit(0), lambda acc, at: acc + again(at))
        return F.size(h["removed"]) + F.size(h["added"]) - 2 * kept

    return F.coalesce(let(hunks(before, after, origin), count), F.lit(0))
