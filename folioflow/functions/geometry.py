"""Annotation geometry in page ratios (0..1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: where an annotation without any position is put.
DEFAULT_POSITION = 0.02
RECT_LIST = "array<struct<x:double,y:double,w:double,h:double>>"


def clamp_ratio(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def normalize_rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Clamped rectangle struct(x,y,w,h); null when a side is missing or empty."""
    left, top = clamp_ratio(x), clamp_ratio(y)
    width = F.least(F.greatest(w, F.lit(0.0)), 1 - left)
    height = F.least(F.greatest(h, F.lit(0.0)), 1 - top)
    given = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    rect = F.struct(left.alias("x"), top.alias("y"), width.alias("w"), height.alias("h"))
    return F.when(given & (width > 0) & (height > 0), rect)


def annotation_point(rect_x: Column, rect_y: Column, pos_x: Column, pos_y: Column) -> Column:
    x = clamp_ratio(F.coalesce(rect_x, pos_x, F.lit(DEFAULT_POSITION)))
    y = clamp_ratio(F.coalesce(rect_y, pos_y, F.lit(DEFAULT_POSITION)))
    return F.struct(x.alias("x"), y.alias("y"))


def _is_list(path: Column) -> Column:
    return F.ltrim(path).startswith("[")


def text_rects(path: Column) -> Column:
    """Highlight rectangles of a JSON path, either a list or {"rects": [...]}; broken JSON gives []."""
    bare = F.from_json(path, RECT_LIST)
    held = F.from_json(path, f"rects {RECT_LIST}")["rects"]
    listed = F.coalesce(F.when(_is_list(path), bare).otherwise(held), F.array().cast(RECT_LIST))

    def number(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    rects = F.transform(
        listed,
        lambda r: normalize_rect(number(r["x"]), number(r["y"]), number(r["w"]), number(r["h"])),
    )
    return F.filter(rects, lambda r: r.isNotNull())


def drawing_points(path: Column) -> Column:
    """Clamped points of a freehand path; entries without both coordinates leave."""
    kind = "array<struct<x:double,y:double>>"
    listed = F.coalesce(F.when(_is_list(path), F.from_json(path, kind)), F.array().cast(kind))
    given = F.filter(listed, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.transform(
        given, lambda p: F.struct(clamp_ratio(p["x"]).alias("x"), clamp_ratio(p["y"]).alias("y"))
    )
