"""Secrets in texts, found through a trigram index, with native expressions only.

``build`` writes an inverted index: for each segment (the rows that one task reads) and trigram, the
numbers of the texts that hold it. Trigrams are those of the lower-cased text without white space. A
text's number is a 32-bit hash of it, so copies share one entry, and two texts with the same number
only cause a needless check. A posting list ends with its segment, so none grows with the corpus.

``candidates`` intersects and joins postings per segment as each rule's Boolean query says
(``trigrams``). ``find_secrets`` then runs a rule's expression on the whole text of its candidates;
rules without a mandatory trigram run on every text. The index never decides, it only spares work:
spans are those of the expressions, leftmost first and without overlap per rule.

Null texts count as empty and hold nothing. Every row gives one result, repeated rows and rows
without an id too; the columns of the input are kept apart from the operator's own in ``row``. Texts
are indexed in overlapping pieces, so memory follows the piece and not the text. Expressions have
to be understood alike by Java and Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.store import packed, small, written
from corpusaudit.llm.trigrams import grams_of, trigram_query

PIECE = 1 << 17  # characters indexed at once
STRETCH = 256  # matches whose positions are summed in one go


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and how many characters its ``group`` needs at least."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The expressions and least lengths of the three base kinds.
ASSIGNED = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
BASE = (
    Rule("assign", ASSIGNED + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),  # the same runs as [0-9a-f]+ of 16 and more
)
# Published shapes of keys, beyond the base kinds.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,255}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


def text_number(text: Column) -> Column:
    return F.hash(text)


def build(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs``: (segment, trigram, texts)."""
    text = docs["text"]
    # a piece runs on for two characters, so every trigram lies in one
    begins = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(PIECE))
    pieces = F.transform(begins, lambda b: F.substring(text, b + 1, F.lit(PIECE + 2)))
    whole = F.when(F.length(text) <= PIECE, F.array(text)).otherwise(pieces)
    cut = docs.filter(text.isNotNull()).select(
        F.spark_partition_id().alias("segment"), text_number(text).alias("number"), F.explode(whole).alias("piece")
    )
    words = F.array_distinct(F.split(F.lower("piece"), r"[ \t\n\x0B\f\r]+"))
    grams = F.array_distinct(F.regexp_extract_all(F.array_join(words, " "), F.lit(r"(?=(\S{3}))"), 1))
    postings = cut.select("segment", "number", F.explode(grams).alias("trigram"))
    return written(
        postings.groupBy("segment", "trigram").agg(F.collect_set("number").alias("texts")), "trigram-index"
    )


def _evaluated(query, postings: Column) -> Column:
    """The texts of one segment that pass a query."""
    if isinstance(query, str):
        return F.coalesce(F.element_at(postings, F.lit(query)), F.array().cast("array<int>"))
    merge = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(merge, [_evaluated(p, postings) for p in query[1]])


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(number, kinds): the texts that the index cannot rule out, for the rules that have a query."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    wanted = sorted(set().union(*[grams_of(q) for q in queries.values()]))
    entry = F.struct("trigram", "texts")
    per_segment = index.filter(F.col("trigram").isin(wanted)).groupBy("segment").agg(
        F.map_from_entries(F.collect_list(entry)).alias("postings")
    )
    found = F.array(*[
        F.struct(F.lit(kind).alias("kind"), _evaluated(q, F.col("postings")).alias("texts")) for kind, q in queries.items()
    ]) if queries else F.array().cast("array<struct<kind:string,texts:array<int>>>")
    pairs = per_segment.select(F.inline(found)).select("kind", F.explode("texts").alias("number"))
    return pairs.groupBy("number").agg(F.collect_set("kind").alias("kinds"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(values: Column, before: Column) -> Column:
    start = F.struct(before.alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(
        values, start,
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x)).alias("all")),
        lambda acc: acc["all"],
    )


def running(lengths: Column) -> Column:
    """Sums of an array of numbers up to and with each element, in stretches so that long arrays
    are not copied once per element."""

    def cut(values: Column) -> Column:
        last = F.greatest(F.floor((F.size(values) - 1) / STRETCH).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda s: F.slice(values, s * STRETCH + 1, STRETCH))

    def summed(stretches: Column) -> Column:
        totals = F.transform(stretches, lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x))
        bases = F.concat(F.array(F.lit(0)), _sums(totals, F.lit(0)))
        return F.flatten(F.zip_with(stretches, bases, lambda s, b: F.coalesce(_sums(s, b), F.array().cast("array<int>"))))

    return let(let(lengths, cut), summed)


def matches(text: Column, rule: Rule) -> Column:
    """What the rule finds in a text: an array of (kind, start, end), in code points. The text is cut
    at the matches, so their places follow from the lengths of the parts."""
    pattern = F.lit(rule.pattern)
    found = F.struct(
        F.transform(F.regexp_extract_all(text, pattern, 0), F.length).alias("lengths"),
        F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length).alias("tested"),
        F.transform(F.split(text, rule.pattern), F.length).alias("gaps"),
    )

    def placed(f: Column) -> Column:
        steps = F.zip_with(F.slice(f["gaps"], F.lit(1), F.size(f["lengths"])), f["lengths"], lambda g, m: g + m)
        spans = F.zip_with(
            running(steps), F.arrays_zip(f["lengths"].alias("n"), f["tested"].alias("tested")),
            lambda end, m: F.struct(F.lit(rule.kind).alias("kind"), (end - m["n"]).alias("start"), end.alias("end"), m["tested"].alias("tested")),
        )
        return F.transform(
            F.filter(spans, lambda s: s["tested"] >= rule.least),
            lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
        )

    return F.when(text.rlike(rule.pattern), let(found, placed)).otherwise(no_spans())


def no_spans() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int>>")


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(row, spans) for every row of ``docs``; ``spans`` holds (kind, start, end) by start, then in
    the order of the rules."""
    indexed = {r.kind for r in rules if trigram_query(r.pattern) is not True}
    found = written(candidates(build(docs), rules), "secret-candidates")
    keyed = packed(docs, text=F.coalesce(docs["text"], F.lit("")), number=text_number(docs["text"]))
    joined = keyed.join(small(found, found.count()), "number", "left")
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    per_rule = [
        matches(F.col("text"), r) if r.kind not in indexed
        else F.when(F.array_contains(kinds, r.kind), matches(F.col("text"), r)).otherwise(no_spans())
        for r in rules
    ]
    order = F.array(F.lit(""), *[F.lit(r.kind) for r in rules])
    ranked = F.transform(
        F.flatten(F.array(no_spans(), *per_rule)),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")),
    )
    spans = F.transform(
        F.sort_array(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )
    return joined.select("row", spans.alias("spans"))


def rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
