"""Text of PDF pages from their items, and the boxes that cover redacted items.

Pages come as a table: ``pages``, array of (width, height, items), items an
array of (text, x, y, font_size, width, eol) in reading order, coordinates
from the lower left corner. Items are those of a text layer or the words of a
recogniser; decoding the file itself is left to whoever makes the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<text:string,x:double,y:double,font_size:double,width:double,eol:boolean>"
PAGES = f"array<struct<width:double,height:double,items:array<{ITEM}>>>"
SEGMENTS = "array<struct<page:int,item:int,start:int,end:int>>"
NO_TEXT = "PDF_NO_TEXT_LAYER"
# Shares of the font size, or of a box's height.
SAME_LINE, WORD_GAP, LINE_BOX = 0.5, 0.25, 0.6
PAD_X, PAD_Y, LEAST_X, LEAST_Y, BELOW, TALL = 0.38, 0.22, 2.0, 1.0, 0.25, 1.15
#: A text may be wider than its place by this factor; a font is no smaller than the second one.
FIT, SMALLEST = 1.02, 4.0


def layout(pages: list[dict]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """(text, segments): items on one line follow each other, with a blank over a gap; a page ends with an empty line."""
    out: list[str] = []
    segments, size, last = [], 0, ""

    def add(s: str) -> None:
        nonlocal size, last
        out.append(s)
        size, last = size + len(s), s[-1]

    for p, page in enumerate(pages):
        line, right = None, 0.0
        for i, item in enumerate(page["items"]):
            if item["text"]:
                if line is not None and abs(item["y"] - line) >= item["font_size"] * SAME_LINE:
                    if last != "\n":
                        add("\n")
                elif line is not None and item["x"] - right > item["font_size"] * WORD_GAP and last != " ":
                    add(" ")
                segments.append((p, i, size, size + len(item["text"])))
                add(item["text"])
                line, right = item["y"], item["x"] + item["width"]
            if item["eol"] and last != "\n":
                add("\n")
                line = None
        if last != "\n":
            add("\n")
        add("\n")
    return "".join(out), segments


def read_pages(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, text, segments, error``: pages without any text have an error and no text. Null pages count as none."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, pages in zip(f[doc], f["pages"], strict=True):
                text, found = layout(list(pages) if pages is not None else [])
                blank = not text.strip()
                rows.append((d, None if blank else text, [] if blank else [dict(zip(("page", "item", "start", "end"), s, strict=True)) for s in found], NO_TEXT if blank else None))
            yield pd.DataFrame(rows, columns=[doc, "text", "segments", "error"])

    return docs.select(doc, F.col("pages").cast(PAGES).alias("pages")).mapInPandas(run, f"`{doc}` {kind}, text string, segments {SEGMENTS}, error string")


def box(item: Column) -> Column:
    """(x, y, width, height) that covers an item with room to spare."""
    size = item["font_size"]
    across, along = F.greatest(F.lit(LEAST_X), size * PAD_X), F.greatest(F.lit(LEAST_Y), size * PAD_Y)
    return F.struct(
        F.greatest(F.lit(0.0), item["x"] - across).alias("x"), F.greatest(F.lit(0.0), item["y"] - size * BELOW - along).alias("y"),
        F.greatest(F.lit(1.0), item["width"] + across * 2).alias("width"), F.greatest(F.lit(1.0), size * TALL + along * 2).alias("height"),
    )


def line_boxes(boxes: Column) -> Column:
    """Boxes of one edit on one page, those of a line as one, from the top down.

    A box joins the first line whose middle is nearer than 0.6 times the
    taller of the two.
    """
    kind = "array<struct<x:double,y:double,width:double,height:double>>"
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct((-b["y"]).alias("up"), b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("width"), b["height"].alias("height"))))

    def step(lines: Column, b: Column) -> Column:
        near = lambda c: F.abs(c["y"] + c["height"] / 2 - b["y"] - b["height"] / 2) <= F.greatest(c["height"], b["height"]) * LINE_BOX
        at = F.array_position(F.transform(lines, near), True)

        def joined(c: Column) -> Column:
            x, y = F.least(c["x"], b["x"]), F.least(c["y"], b["y"])
            right, top = F.greatest(c["x"] + c["width"], b["x"] + b["width"]), F.greatest(c["y"] + c["height"], b["y"] + b["height"])
            return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (top - y).alias("height"))

        own = F.struct(*[b[c].alias(c) for c in ("x", "y", "width", "height")])
        return F.when(at == 0, F.array_append(lines, own)).otherwise(F.transform(lines, lambda c, i: F.when(i + 1 == at, joined(c)).otherwise(c)))

    return F.aggregate(ordered, F.array().cast(kind), step)


def redaction_boxes(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, edit, page, boxes`` for each edit (start, end, ...) and page it touches, from columns pages, segments and edits.

    Segments and edits meet by the document and the thousand of code points
    they lie in, not all with all.
    """
    thousand = lambda a, b: F.explode(F.sequence(F.floor(a / 1000), F.floor((b - 1) / 1000)))
    stretch = docs.select(doc, "pages", F.explode("segments").alias("s"))
    stretch = stretch.select(doc, F.col("s.page").alias("page"), F.col("s.item").alias("item"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), box(F.get(F.get("pages", F.col("s.page"))["items"], F.col("s.item"))).alias("box"))
    stretch = stretch.withColumn("part", thousand(F.col("start"), F.col("end")))
    edit = docs.select(doc, F.posexplode("edits").alias("edit", "e")).filter("e.end > e.start")
    edit = edit.select(doc, "edit", F.col("e.start").alias("a"), F.col("e.end").alias("b"), thousand(F.col("e.start"), F.col("e.end")).alias("part"))
    met = edit.join(stretch, [doc, "part"]).filter("end > a AND start < b").select(doc, "edit", "page", "item", "box").distinct()
    return met.groupBy(doc, "edit", "page").agg(line_boxes(F.transform(F.array_sort(F.collect_list(F.struct("item", "box"))), lambda x: x["box"])).alias("boxes"))


def sanitized(text: Column, supported: Column) -> Column:
    """Characters that a font lacks become ``?``, control characters vanish; ``supported`` is an array of characters."""
    shown = lambda c: F.when(F.array_contains(supported, c), c).otherwise(F.when(F.ascii(c) < 32, "").otherwise("?"))
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(F.split(text, "(?s)(?<=.)(?=.)"), shown), ""))


def fit_size(size: Column, width: Column, most: Column) -> Column:
    """The font size at which a text of ``width`` at ``size`` fits into ``most``; unchanged if there is no place or it fits."""
    return F.when((most <= 0) | (width <= most * FIT), size).otherwise(F.greatest(F.lit(SMALLEST), size * most / width))
