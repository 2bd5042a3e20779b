"""What a reviewer sees: decorated pieces of a text, tables of a Word file, the grid of a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.deidentify import marker
from .masks import mask

#: What a grid shows at most; rows and columns beyond it are processed all the same.
GRID_ROWS, GRID_COLUMNS = 1000, 60
PIECES = "array<struct<kind:string,start:int,end:int,id:string,label:string>>"


def decorations(items: Column, codes: bool) -> Column:
    """array of (start, end, id, kind, label): active items as marks with their marker or mask, others as cancelled with no label."""
    label = lambda x: marker(x["category"], x["code"]) if codes else mask(x["category"], x["original"])
    return F.transform(
        F.array_sort(items),
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["id"].alias("id"),
            F.when(x["active"], "mark").otherwise("cancelled").alias("kind"), F.when(x["active"], label(x)).otherwise("").alias("label"),
        ),
    )


def restored_decorations(edits: Column) -> Column:
    """Decorations of a restored text's edits (start, end, replacement): the originals, where their markers are."""
    return F.transform(F.array_sort(edits), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.lit(None).cast("string").alias("id"), F.lit("restored").alias("kind"), e["replacement"].alias("label")))


def pieces(text: Column, start: Column, end: Column, decorated: Column) -> Column:
    """array of (kind, start, end, id, label) that make up ``text`` from ``start`` to ``end``: plain pieces and decorations in turn.

    Decorations, sorted by start, are cut at the borders. Plain and cancelled
    pieces show their text; a mark shows its label only in the piece where it
    begins. An empty range has no pieces.
    """
    shown = lambda a, b: F.substring(text, a + 1, b - a)
    piece = lambda kind, a, b, i, label: F.array(F.struct(kind.alias("kind"), a.alias("start"), b.alias("end"), i.alias("id"), label.alias("label"))).cast(PIECES)
    plain = lambda a, b: F.when(b > a, piece(F.lit("plain"), a, b, F.lit(None).cast("string"), shown(a, b))).otherwise(F.array().cast(PIECES))
    inside = F.filter(decorated, lambda d: (d["end"] > start) & (d["start"] < end))

    def step(acc: Column, d: Column) -> Column:
        a, b = F.greatest(d["start"], start), F.least(d["end"], end)
        label = F.when(d["kind"] == "cancelled", shown(a, b)).otherwise(F.when(d["start"] >= start, d["label"]).otherwise(""))
        return F.struct(F.concat(acc["out"], plain(acc["at"], a), piece(d["kind"], a, b, d["id"], label)).alias("out"), b.alias("at"))

    first = F.struct(F.array().cast(PIECES).alias("out"), start.cast("int").alias("at"))
    return F.aggregate(inside, first, step, lambda acc: F.concat(acc["out"], plain(acc["at"], end.cast("int"))))


def column_letters(n: Column) -> Column:
    """1 as A, 27 as AA; numbers under 1 as nothing."""

    def step(acc: Column, _: Column) -> Column:
        digit = (acc["n"] - 1) % 26
        letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (digit + 1).cast("int"), F.lit(1))
        going = acc["n"] > 0
        return F.struct(F.when(going, F.floor((acc["n"] - 1) / 26)).otherwise(0).cast("long").alias("n"), F.when(going, F.concat(letter, acc["s"])).otherwise(acc["s"]).alias("s"))

    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["s"])


def word_tables(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, part, table, row, col, paragraphs`` (texts in order) of every cell of a Word file's tables."""
    rows = docs.select(doc, text, F.explode("paragraphs").alias("p")).filter("p.table IS NOT NULL")
    own = F.struct(F.col("p.start").alias("start"), F.substring(F.col(text), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("text"))
    cells = rows.groupBy(doc, "p.part", "p.table", "p.row", "p.col").agg(F.array_sort(F.collect_list(own)).alias("own"))
    return cells.select(doc, "part", "table", "row", "col", F.transform("own", lambda x: x["text"]).alias("paragraphs"))


def sheet_grid(docs: DataFrame, doc: str = "doc_id", text: str = "text", max_rows: int = GRID_ROWS, max_columns: int = GRID_COLUMNS) -> DataFrame:
    """``doc, sheet, row, cells`` (letters to text) of the rows that a grid shows, with ``rows`` and ``columns`` of the whole sheet."""
    cells = docs.select(doc, text, F.explode("cells").alias("c")).select(doc, F.col("c.sheet").alias("sheet"), F.col("c.row").alias("row"), F.col("c.col").alias("col"), F.substring(F.col(text), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("shown"))
    whole = cells.groupBy(doc, "sheet").agg(F.max("row").alias("rows"), F.max("col").alias("columns"))
    seen = cells.filter((F.col("row") <= max_rows) & (F.col("col") <= max_columns))
    grid = seen.groupBy(doc, "sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("col"), F.col("shown"))))).alias("by_number"))
    grid = grid.select(doc, "sheet", "row", F.transform_keys("by_number", lambda k, _: column_letters(k)).alias("cells"))
    return grid.join(whole, [doc, "sheet"])
