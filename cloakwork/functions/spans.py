"""Spans of a text column, kept as arrays in the document's row, so that nothing here shuffles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOK_BACK = 80
Check = Callable[[Column, Column], Column]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: within a lambda a plain expression is computed at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows out evenly where files give fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


SPANS = "array<struct<start:int,end:int>>"
#: Matches that are folded at once, so that a text's spans cost no more than about its matches.
PART = 64


def find_all(text: Column, regex: str, check: Check | None = None, hint: Column | None = None) -> Column:
    """array<struct<start,end>> of leftmost non-overlapping matches, code points, end exclusive.

    ``check(match, before)`` drops matches, which still use up their text;
    ``before`` is the text of the previous 80 code points. Offsets come from a
    running sum over the texts between the matches. Texts for which ``hint``
    is false have no match and are not searched; those without a match are
    searched once, others twice. Null text has no spans.
    """
    none = F.array().cast(SPANS)

    def fold(pieces: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + F.length(x["g"])
            b = a + F.coalesce(F.length(x["m"]), F.lit(0))
            good = F.length(x["m"]) > 0
            if check is not None:
                before = F.substring(text, F.greatest(a - LOOK_BACK, F.lit(0)) + 1, F.least(a, F.lit(LOOK_BACK)))
                good = good & check(x["m"], before)
            out = F.when(good, F.array_append(acc["out"], F.struct(a.alias("start"), b.alias("end")))).otherwise(acc["out"])
            return F.struct(b.alias("at"), out.alias("out"))

        return F.aggregate(pieces, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def in_parts(pieces: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(PART)), lambda i: F.slice(pieces, i, PART))
        length = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(parts, start, lambda acc, part: F.struct((acc["at"] + length(part)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, starts, fold))

    def spans(matches: Column) -> Column:
        pieces = F.arrays_zip(F.split(text, regex, -1).alias("g"), matches.alias("m"))
        return F.when(F.size(matches) > 0, let(pieces, in_parts)).otherwise(none)

    found = let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), spans)
    return F.when(text.isNotNull() if hint is None else hint, found).otherwise(none)


def resolve(candidates: Column, fields: Sequence[str]) -> Column:
    """Greedy choice without overlaps: longest first, then smaller start, then smaller ``ord``; result by start.

    Where no candidate reaches into the next one, all are chosen at once.
    """
    key = lambda c: F.struct((c["start"] - c["end"]).alias("_n"), c["start"].alias("start"), c["ord"].alias("ord"), *[c[f].alias(f) for f in fields if f not in ("start", "ord")])
    plain = lambda c: F.struct(c["start"].alias("start"), *[c[f].alias(f) for f in fields if f != "start"])
    clash = lambda c: lambda o: (c["start"] < o["end"]) & (c["end"] > o["start"])

    def choose(ordered: Column) -> Column:
        empty = F.filter(ordered, lambda _: F.lit(False))
        return F.aggregate(ordered, empty, lambda acc, c: F.when(F.exists(acc, clash(c)), acc).otherwise(F.array_append(acc, c)))

    def whole(by_start: Column) -> Column:
        following = F.slice(by_start, 2, F.greatest(F.size(by_start), F.lit(1)))
        apart = F.forall(F.zip_with(by_start, following, lambda c, n: F.coalesce(c["end"] <= n["start"], F.lit(True))), lambda x: x)
        chosen = let(F.array_sort(F.transform(by_start, key)), choose)
        return F.when(apart, by_start).otherwise(F.array_sort(F.transform(chosen, plain)))

    return let(F.array_sort(F.transform(candidates, plain)), whole)


def splice(text: Column, edits: Column) -> Column:
    """``text`` with each (start, end, replacement) applied; overlapping edits raise an error."""
    ordered = F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement"))))

    def step(acc: Column, e: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, e["start"] - acc["at"])
        out = F.when(e["start"] < acc["at"], F.raise_error(F.lit("edits overlap")).cast("string")).otherwise(F.concat(acc["out"], gap, e["replacement"]))
        return F.struct(out.alias("out"), e["end"].alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def utf16_offset(text: Column, n: Column) -> Column:
    """A code-point offset as UTF-16 code units."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), n), "UTF-16BE")) / 2).cast("int")
