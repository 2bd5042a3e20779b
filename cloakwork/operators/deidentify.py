"""Detect, code, redact and restore; all in the document's row but for the look-up in the mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import find_all, let, resolve, splice, unused
from .rules import BUILTIN, Rule, compiles

MARKER = r"\[([^\[\]:]{1,10}):([0-9a-f]{6})\]"
CODES = 1 << 24
ITEM = "array<struct<start:int,ord:int,end:int,category:string>>"

ITEMS = "array<struct<start:int,end:int,category:string,original:string,code:string,origin:string,active:boolean,id:string>>"


def candidates(text: Column, rules: Sequence[Rule]) -> Column:
    """All rules' matches in rule order, in one projection, so the text is read once and scanned once a rule that its hint admits.

    Custom rules that do not compile are left out.
    """
    out = []
    for i, r in enumerate(r for r in rules if r.enabled and (r.builtin or compiles(r.regex))):
        out.append(_tag(find_all(text, r.java, r.check, r.hint(text)), i, r.category))
    return F.concat(*out) if out else F.array().cast(ITEM)


def _tag(spans: Column, i: int, category: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("ord"), s["end"].alias("end"), F.lit(category).alias("category")))


def code_of(rank: Column, doc: Column, key: str) -> Column:
    """Six hex digits: a keyed permutation of the rank of a value within its document, so codes never depend on values."""

    def half(i: Column, x: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(key), doc, i, x), F.lit(4096))

    def step(acc: Column, i: Column) -> Column:
        return F.struct(acc["r"].alias("l"), ((acc["l"] + half(i, acc["r"])) % 4096).alias("r"))

    start = F.struct(F.floor(rank / 4096).cast("long").alias("l"), (rank % 4096).cast("long").alias("r"))
    value = F.aggregate(F.lit([1, 2, 3, 4]), start, step, lambda p: p["l"] * 4096 + p["r"])
    full = F.raise_error(F.lit("no code is left in this document")).cast("string")
    return F.when(rank >= CODES, full).otherwise(F.lpad(F.lower(F.hex(value)), 6, "0"))


def detect(docs: DataFrame, rules: Sequence[Rule] = BUILTIN, *, key: str, doc: str = "doc_id", text: str = "text", more: tuple[Column, str] | None = None) -> DataFrame:
    """``docs`` with ``items``: array of (start, end, category, original, code, origin, active, id), by start.

    Equal (category, original) in a document share a code; ``key`` is secret,
    as it tells the order of the codes. Ids are r1, r2 ... within a document.
    Null text has no items. ``more`` (spans, category) adds spans that are no
    items yet, whatever they overlap. Nothing is shuffled.
    """
    body = F.col(text)

    def named(c: Column) -> Column:
        original = F.substring(body, c["start"] + 1, c["end"] - c["start"])
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["category"].alias("category"), original.alias("original"))

    value = lambda x: F.concat_ws(":", x["category"], x["original"])

    def coded(found: Column) -> Column:
        def items(values: Column, codes: Column) -> Column:
            def item(x: Column, i: Column) -> Column:
                code = F.element_at(codes, F.array_position(values, value(x)).cast("int"))
                rest = (code.alias("code"), F.lit("auto").alias("origin"), F.lit(True).alias("active"), item_id(i + 1).alias("id"))
                return F.struct(*[x[c].alias(c) for c in ("start", "end", "category", "original")], *rest)

            return F.transform(found, item)

        codes = lambda values: F.transform(values, lambda _, i: code_of(i.cast("long"), F.col(doc), key))
        return let(F.array_distinct(F.transform(found, value)), lambda values: let(codes(values), lambda c: items(values, c)))

    chosen = resolve(candidates(body, rules), ("start", "ord", "end", "category"))
    if more is not None:
        added = _tag(more[0], len(rules), more[1])
        fresh = lambda known: F.filter(added, lambda x: ~F.exists(known, lambda c: (c["start"] == x["start"]) & (c["end"] == x["end"])))
        chosen = let(chosen, lambda known: F.array_sort(F.concat(known, fresh(known))))
    none = F.array().cast(ITEMS)
    found = let(chosen, lambda c: F.when(F.size(c) > 0, let(F.transform(c, named), coded)).otherwise(none))
    return docs.withColumn("items", F.coalesce(found.cast(ITEMS), none))


def item_id(n: Column) -> Column:
    return F.concat(F.lit("r"), n.cast("string"))


def edits_of(items: Column) -> Column:
    """array of (start, end, replacement): the marker of each active item in its place."""
    active = F.filter(items, lambda x: x["active"])
    return F.transform(active, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), marker(x["category"], x["code"]).alias("replacement")))


def marker(category: Column, code: Column) -> Column:
    return F.concat(F.lit("["), category, F.lit(":"), code, F.lit("]"))


def redact(items_df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``redacted`` and ``mapping`` (array of code, category, original; active values by first occurrence)."""
    active = F.filter("items", lambda x: x["active"])
    edits = edits_of(F.col("items"))
    mapping = F.array_distinct(F.transform(active, lambda x: F.struct(x["code"].alias("code"), x["category"].alias("category"), x["original"].alias("original"))))
    return items_df.withColumn("redacted", splice(F.col(text), edits)).withColumn("mapping", mapping)


def mapping_rows(redacted: DataFrame, doc: str = "doc_id") -> DataFrame:
    # an outer explode: a plain one has its array tested, hence computed, again in a filter below
    rows = redacted.select(doc, F.posexplode_outer("mapping").alias("position", "m")).filter("m IS NOT NULL")
    return rows.select(doc, "position", "m.code", "m.category", "m.original")


def markers(text: Column) -> Column:
    """array of (category, code, start, end) of all markers."""
    part = lambda s, i: F.regexp_extract(F.substring(text, s["start"] + 1, s["end"] - s["start"]), MARKER, i)
    return F.transform(find_all(text, MARKER, None, text.contains("[")), lambda s: F.struct(part(s, 1).alias("category"), part(s, 2).alias("code"), s["start"].alias("start"), s["end"].alias("end")))


def restore(docs: DataFrame, mapping: DataFrame, doc: str = "doc_id", text: str = "redacted") -> DataFrame:
    """Adds ``restored``, ``restored_count`` and ``missing`` (distinct codes without an original, as first seen).

    The mapping is gathered by document and joined once; the category of a
    marker is not compared, and originals that look like markers stay as they
    are. If a code repeats, the first row counts, by ``position`` or ``line``
    where the mapping has it, else the smallest original, as rows of a table
    have no order. Null text stays null; input columns of the added names are
    replaced.
    """
    order = next((c for c in ("position", "line") if c in mapping.columns), "original")
    d, own, b = (unused(docs, x) for x in ("d", "own", "book"))
    first = mapping.groupBy(F.col(doc).alias(d), "code").agg(F.min_by("original", F.struct(F.col(order), F.col("original"))).alias("original"))
    book = first.groupBy(d).agg(F.map_from_entries(F.collect_list(F.struct("code", "original"))).alias(b))
    out = docs.withColumn(own, F.col(doc)).join(book, F.col(own) == F.col(d), "left")
    return _looked_up(out, F.col(b), text, [c for c in docs.columns if c not in RESTORED])


def restore_own(docs: DataFrame, mapping: str = "mapping", text: str = "redacted") -> DataFrame:
    """``restore`` with each row's own ``mapping`` (array of code, category, original); the first of a code counts. Nothing is shuffled."""
    first = F.filter(mapping, lambda m, i: ~F.exists(F.slice(mapping, F.lit(1), i), lambda o: o["code"] == m["code"]))
    b = unused(docs, "book")
    out = docs.withColumn(b, F.map_from_entries(F.transform(first, lambda m: F.struct(m["code"], m["original"]))))
    return _looked_up(out, F.col(b), text, [c for c in docs.columns if c not in RESTORED])


RESTORED = ("restored", "restored_count", "missing")


def _looked_up(docs: DataFrame, book: Column, text: str, kept: list[str]) -> DataFrame:
    """``text`` with the originals that ``book`` (code to original) has in place of the markers."""
    m = unused(docs, "m")
    out = docs.withColumn(m, markers(F.col(text)))
    known = F.filter(m, lambda x: book[x["code"]].isNotNull())
    edits = F.transform(known, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), book[x["code"]].alias("replacement")))
    lost = F.array_distinct(F.transform(F.filter(m, lambda x: book[x["code"]].isNull()), lambda x: x["code"]))
    return out.select(*kept, splice(F.col(text), edits).alias("restored"), F.size(known).alias("restored_count"), lost.alias("missing"))
