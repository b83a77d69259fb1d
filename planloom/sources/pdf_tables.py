"""Flat tables from nested page records of a PDF reader.

A page record holds what one page shows; it is bounded by the page. All
flattening happens next to the scan, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions import geometry as G, text as T

BOX_TYPE = "struct<x0:double,y0:double,x1:double,y1:double>"
POINT_TYPE = "struct<x:double,y:double>"
SPAN_TYPE = (f"struct<text:string,bbox:{BOX_TYPE},origin:{POINT_TYPE},size:double,color:int,"
             "font:string,flags:int>")
SPAN_PAGE_SCHEMA = (f"doc_id long, page_index int, blocks array<struct<type:int,lines:array<struct<"
                    f"dir:struct<dx:double,dy:double>,spans:array<{SPAN_TYPE}>>>>>")
TRACE_TYPE = (f"struct<type:int,chars:array<struct<cp:int,origin:{POINT_TYPE},bbox:{BOX_TYPE}>>,"
              f"dir:struct<dx:double,dy:double>,size:double,ascender:double,descender:double,bbox:{BOX_TYPE}>")
TRACE_PAGE_SCHEMA = f"doc_id long, page_index int, traces array<{TRACE_TYPE}>"
DRAWING_TYPE = (f"struct<width:double,fill:boolean,fill_opacity:double,stroke_opacity:double,"
                f"items:array<struct<op:string,pts:array<{POINT_TYPE}>>>>")
DRAWING_PAGE_SCHEMA = f"doc_id long, page_index int, drawings array<{DRAWING_TYPE}>"

# fixed values: style bits of a span
BOLD_BIT, ITALIC_BIT = 4, 1


def flatten_spans(pages: DataFrame) -> DataFrame:
    """One row per non-blank span of the text blocks, with RGB in 0..1."""
    keys = [c for c in pages.columns if c != "blocks"]
    spans = (pages.select(*keys, F.posexplode("blocks").alias("block_no", "b")).where(F.col("b.type") == 0)
             .select(*keys, "block_no", F.posexplode("b.lines").alias("line_no", "l"))
             .select(*keys, "block_no", "line_no", F.col("l.dir").alias("dir"),
                     F.posexplode("l.spans").alias("span_no", "s"))
             .where(T.strip(F.col("s.text")) != ""))

    def channel(shift):
        return F.shiftright("s.color", shift).bitwiseAND(F.lit(255)) / 255

    def bit(n):
        return F.col("s.flags").bitwiseAND(F.lit(1 << n)) != 0

    return spans.select(
        *keys, "block_no", "line_no", "span_no", F.col("s.text").alias("text"), F.col("dir.dx").alias("dx"),
        F.col("dir.dy").alias("dy"), *[F.col(f"s.bbox.{c}").alias(c) for c in G.BOX],
        F.col("s.origin.x").alias("ox"), F.col("s.origin.y").alias("oy"), F.col("s.size").alias("size"),
        F.col("s.font").alias("font"), channel(16).alias("red"), channel(8).alias("green"),
        channel(0).alias("blue"), bit(BOLD_BIT).alias("bold"), bit(ITALIC_BIT).alias("italic"))


def code_point_text(chars: Column) -> Column:
    """Text of an array of structs with a code point ``cp``."""
    hexed = F.array_join(F.transform(chars, lambda c: F.lpad(F.hex(c["cp"]), 8, "0")), "")
    return F.decode(F.unhex(hexed), "UTF-32")


def flatten_traces(pages: DataFrame) -> DataFrame:
    """Visible glyph runs, numbered by content order from 0 on each page."""
    keys = [c for c in pages.columns if c != "traces"]
    shown = F.filter("traces", lambda t: (t["type"] == 0) & (F.size(t["chars"]) > 0))
    runs = pages.select(*keys, F.posexplode(shown).alias("run_index", "t"))
    first, last = F.col("t.chars")[0], F.element_at("t.chars", -1)
    return runs.select(
        *keys, F.col("run_index").cast("long").alias("run_index"), code_point_text(F.col("t.chars")).alias("text"),
        F.col("t.dir.dx").alias("dx"), F.col("t.dir.dy").alias("dy"), F.col("t.size").alias("size"),
        F.col("t.ascender").alias("ascender"), F.col("t.descender").alias("descender"),
        first["origin"]["x"].alias("sx"), first["origin"]["y"].alias("sy"),
        last["origin"]["x"].alias("lx"), last["origin"]["y"].alias("ly"),
        (last["bbox"]["x1"] - last["bbox"]["x0"]).alias("lw"),
        (last["bbox"]["y1"] - last["bbox"]["y0"]).alias("lh"),
        *[F.col(f"t.bbox.{c}").alias(c) for c in G.BOX])


def flatten_drawings(pages: DataFrame) -> DataFrame:
    """Rectangles that path items occupy: segments, edges, fills, envelopes."""
    keys = [c for c in pages.columns if c != "drawings"]
    items = (pages.select(*keys, F.posexplode("drawings").alias("drawing_no", "d"))
             .select(*keys, "drawing_no", "d", F.posexplode("d.items").alias("item_no", "i")))
    pad = F.greatest(F.coalesce("d.width", F.lit(0.0)) / 2, F.lit(0.5))
    xs = F.transform("i.pts", lambda p: p["x"])
    ys = F.transform("i.pts", lambda p: p["y"])
    items = items.select(*keys, "drawing_no", "item_no", F.col("i.op").alias("op"), pad.alias("pad"),
                         F.coalesce("d.fill", F.lit(False)).alias("fill"), F.array_min(xs).alias("a"),
                         F.array_min(ys).alias("b"), F.array_max(xs).alias("c"), F.array_max(ys).alias("e"))
    a, b, c, e, p = (F.col(n) for n in ("a", "b", "c", "e", "pad"))

    def rect(x0, y0, x1, y1, grow):
        return F.struct((x0 - grow).alias("x0"), (y0 - grow).alias("y0"), (x1 + grow).alias("x1"),
                        (y1 + grow).alias("y1"))

    edges = F.array(rect(a, b, c, b, p), rect(c, b, c, e, p), rect(a, e, c, e, p), rect(a, b, a, e, p))
    boxes = (F.when((F.col("op") == "re") & F.col("fill"), F.array(rect(a, b, c, e, F.lit(0.0))))
             .when(F.col("op") == "re", edges)
             .when(F.col("op").isin("l", "c", "qu"), F.array(rect(a, b, c, e, p))))
    return items.select(*keys, "drawing_no", "item_no", "op", F.inline(boxes))
