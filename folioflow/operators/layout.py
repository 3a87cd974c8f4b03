"""Chapters of pages and places on a page."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import ordered
from .ordered import BLOCK_ROWS, Running, carried, number_blocks, running

#: labels whose heights differ by less than this stand in one row of drawings
ROW_REACH = 20.0
#: image regions: least side, how far below the label's line one may end, least reach to both sides and
#: its share of the width, and the height beyond which the nearest one is not the label's
LEAST_SIDE, OVERLAP, LEAST_REACH, REACH_SHARE, MAX_HEIGHT = 40.0, 12.0, 60.0, 1.5, 160.0
#: height of a strip in rows, labels of a strip and labels and regions of a page that one task may hold
STRIP_ROWS, STRIP_LABELS, PAGE_PLACES = 64, 1 << 18, 1 << 20


def chapter_for_pages(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """Chapter of every page: the last outline entry at or before it, else the last chapter heading
    detected on a page up to it.

    ``pages`` has doc_id, page and detected; ``outline`` has doc_id, page, title and seq (the later of
    two entries on one page counts). Both walk together, so this is a scan and not a range join.
    """
    entries = outline.groupBy("doc_id", "page").agg(F.max_by("title", "seq").alias("outlined"))
    both = (
        pages.select("doc_id", "page", "detected", F.lit(None).cast("string").alias("outlined"), F.lit(1).alias("kind"))
        .unionByName(
            entries.select(
                "doc_id", "page", F.lit(None).cast("string").alias("detected"), "outlined", F.lit(0).alias("kind")
            )
        )
    )
    filled = carried(
        both,
        ["doc_id"],
        ["page", "kind"],
        number_blocks("page"),
        {"_outline": F.col("outlined"), "_page": F.col("detected")},
    )
    return filled.where("kind = 1").select(
        "doc_id", "page", "detected", F.coalesce("_outline", "_page").alias("chapter")
    )

# rank ranges of a power-of-two size: the ones around a rank, and the fewest that make up first .. past - 1
_LOWER, _UPPER = "shiftright(first + shiftleft(1L, k) - 1, k)", "shiftright(past, k)"
SLOTS_AROUND = "explode(transform(sequence(0, _top), k -> struct(k as level, shiftright(rank, k) as slot))) as s"
SLOTS_OF_RANGE = (
    f"explode(filter(flatten(transform(sequence(0, _top), k -> array("
    f"if({_LOWER} < {_UPPER} and {_LOWER} % 2 = 1, struct(k as level, {_LOWER} as slot), null), "
    f"if({_LOWER} < {_UPPER} and {_UPPER} % 2 = 1, struct(k as level, {_UPPER} - 1 as slot), null)))), "
    f"x -> x is not null)) as s"
)


def _top_levels(labels: DataFrame) -> DataFrame:
    """The largest level that a page's ranks need."""
    return labels.groupBy("page").agg((F.length(F.bin(F.count(F.lit(1)))) - 1).alias("_top"))


def _places(col: str, kind: str) -> list:
    """Blocks of rows ordered by a place on the page, a kind and a label."""
    place = F.col(col)
    return [F.floor(place / 64), F.floor(place), place, F.col(kind), F.expr(f"label_id div {BLOCK_ROWS}")]


def row_ranges(labels: DataFrame, reach: float) -> DataFrame:
    """Rank of every label by height on its page, and the ranks ``first`` to ``past`` - 1 of its row.

    Input is (page, label_id, center, y). Three events per label walk down the page together: where its
    row begins, the label, and where its row ends; a running count of labels gives all three ranks.
    """
    events = labels.select(
        "page", "label_id", "center",
        F.explode(
            F.array(
                F.struct((F.col("y") + reach).alias("at"), F.lit(-1).alias("kind")),
                F.struct(F.col("y").alias("at"), F.lit(0).alias("kind")),
                F.struct((F.col("y") - reach).alias("at"), F.lit(1).alias("kind")),
            )
        ).alias("e"),
    ).select("page", "label_id", "center", "e.*")
    passed = {"_passed": Running("sum", (F.col("kind") == 0).cast("long"))}
    counted = running(events, ["page"], ["at", "kind", "label_id"], _places("at", "kind"), passed)

    def at(kind: int):
        return F.max(F.when(F.col("kind") == kind, F.col("_passed")))

    return counted.groupBy("page", "label_id", "center").agg(
        (at(0) - 1).alias("rank"), at(1).alias("first"), at(-1).alias("past")
    )


def _parted(groups: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Pages with a group too large for one task; None if there is no such page."""
    most = min(limit, ordered.HOT_ROWS)
    hot = groups.groupBy(*keys).count().where(F.col("count") > most).select("page").distinct()
    return None if hot.isEmpty() else settle(hot)


def _beside(labels: pa.Table, reach: float) -> pa.Table:
    """Neighbours of the asking labels of one strip: a window of sorted centers moves down the page."""
    heights = labels["y"].to_numpy()
    order = np.argsort(heights, kind="stable")
    y, here = heights[order], np.arange(len(order))
    firsts = np.minimum(np.searchsorted(y, y - reach, side="right"), here).tolist()
    pasts = np.maximum(np.searchsorted(y, y + reach, side="left"), here + 1).tolist()
    centers = labels["center"].to_numpy()[order].tolist()
    asks = labels["asks"].to_numpy(zero_copy_only=False)[order]
    near: list[float] = []
    first = past = 0
    lefts, rights = [], []
    for center, begin, end, ask in zip(centers, firsts, pasts, asks.tolist()):
        while past < end:
            insort(near, centers[past])
            past += 1
        while first < begin:
            del near[bisect_left(near, centers[first])]
            first += 1
        if ask:
            at = bisect_left(near, center)
            lefts.append(near[at - 1] if at else None)
            rights.append(near[at + 1] if at + 1 < len(near) else None)
    out = labels.select(["page", "label_id", "center"]).take(pa.array(order[asks]))
    return out.append_column("left", pa.array(lefts, pa.float64())).append_column("right", pa.array(rights, pa.float64()))


def row_neighbours(labels: DataFrame, reach: float = ROW_REACH) -> DataFrame:
    """Nearest centers left and right of each label among the labels of its row, without pairs.

    A page is cut into strips many rows high. A label asks in its own strip and stands in those that its
    row touches, so a strip is answered by itself. Pages with a strip too large for a task go through
    :func:`ranked_neighbours`. Labels are unique per page. Of equal centers the others count as right
    neighbours; null means that there is none on that side.
    """
    single = settle(labels.groupBy("page", "label_id", "center").agg(F.max("y").alias("y")))
    height = STRIP_ROWS * reach
    own = F.floor(F.col("y") / height)
    touched = F.sequence(F.floor((F.col("y") - 2 * reach) / height), F.floor((F.col("y") + 2 * reach) / height))
    strips = single.select("*", F.explode(touched).alias("strip")).withColumn("asks", F.col("strip") == own)
    hot = _parted(strips, ["page", "strip"], STRIP_LABELS)
    if hot is not None:
        strips = strips.join(hot, "page", "left_anti")
    kinds = dict(labels.dtypes)
    found = strips.groupBy("page", "strip").applyInArrow(
        lambda strip: _beside(strip, reach),
        f"page {kinds['page']}, label_id {kinds['label_id']}, center double, left double, right double",
    )
    return found if hot is None else found.unionByName(ranked_neighbours(single.join(hot, "page", "left_semi"), reach))


def ranked_neighbours(labels: DataFrame, reach: float) -> DataFrame:
    """:func:`row_neighbours` for pages of any size.

    Heights of a page are ranked; each label speaks in the log(n) power-of-two rank ranges around it and
    asks in the at most 2 log(n) ranges that make up its row. Inside a range the neighbours are the last
    speaker before and after it by center.
    """
    placed = settle(row_ranges(labels, reach).join(_top_levels(labels), "page"))
    where = ["page", "level", "slot"]
    speak = (
        placed.selectExpr("page", "center", SLOTS_AROUND)
        .groupBy("page", "s.level", "s.slot", "center")
        .agg(F.count(F.lit(1)).alias("_same"))
    )
    ask = placed.selectExpr("page", "label_id", "center", SLOTS_OF_RANGE).select("page", "s.level", "s.slot", "center", "label_id")
    nobody, nothing = F.lit(None).cast("long").alias("label_id"), F.lit(None).cast("double").alias("_center")
    both = settle(
        speak.select(*where, "center", nobody, F.col("center").alias("_center"), F.lit(1).alias("down"), F.lit(0).alias("up"))
        .unionByName(ask.select(*where, "center", "label_id", nothing, F.lit(0).alias("down"), F.lit(1).alias("up")))
    )
    last = Running("last", F.col("_center"))
    answers = [
        running(both, where, ["center", kind, "label_id"], _places("center", kind), {side: last}, reverse)
        .where("label_id is not null")
        .groupBy("page", "label_id", "center")
        .agg(pick(side).alias(side))
        for side, kind, reverse, pick in (("left", "down", False, F.max), ("right", "up", True, F.min))
    ]
    same = ask.join(speak, [*where, "center"]).groupBy("page", "label_id", "center").agg(F.sum("_same").alias("_same"))
    key = ["page", "label_id", "center"]
    return answers[0].join(answers[1], key).join(same, key).select(
        *key, "left", F.when(F.col("_same") > 1, F.col("center")).otherwise(F.col("right")).alias("right")
    )


def horizontal_limits(labels: DataFrame, pages: DataFrame, reach: float = ROW_REACH) -> DataFrame:
    """Left and right bound of each label's drawing: half way to its neighbours in the row.

    ``labels`` has page, label_id, x, y and width; ``pages`` has page, page_left and page_right, one row
    per page. A side without neighbour takes the other side's distance; a label alone in its row gets
    the page's bounds. Labels that lack a page or a place get null bounds.
    """
    here = F.col("x").cast("double") + F.col("width") / 2
    centers = labels.select("page", "label_id", here.alias("center"), F.col("y").cast("double").alias("y"))
    near = row_neighbours(centers.dropna(), reach)
    before, after = F.col("center") - F.col("left"), F.col("right") - F.col("center")
    bounds = near.join(pages.select("page", "page_left", "page_right"), "page", "left").select(
        "page", "label_id",
        F.coalesce(F.col("center") - F.coalesce(before, after) / 2, "page_left").alias("left_bound"),
        F.coalesce(F.col("center") + F.coalesce(after, before) / 2, "page_right").alias("right_bound"),
    )
    return labels.join(bounds, ["page", "label_id"], "left")


def _walk(spots: np.ndarray, heights: np.ndarray, bottoms: np.ndarray, spans: list, values: list, banded: bool, reverse: bool):
    """The regions that answer each label on the three spans of x, numbers from ``len(bottoms)`` on for none.

    ``spots`` and ``heights`` are the labels' ranks by center and their places, ``spans`` the first and
    past rank of every region on each span, ``values`` the regions' places by what they say there. Labels
    and regions of one range (and band) are put in order, and a running least value answers each label.
    """
    none, marks = len(bottoms), len(bottoms) + len(heights)
    at = np.concatenate([bottoms, heights])
    place = np.empty(marks, np.int64)
    place[np.lexsort((np.arange(marks) >= none, at))] = np.arange(marks)
    band = np.floor(at / OVERLAP) if banded else np.zeros(marks)
    if reverse:
        place = marks - 1 - place
    best = [np.full(len(heights), none, np.int64) for _ in spans]
    for k in range(int(len(spots)).bit_length()):
        slots = spots >> k
        for (first, past), value, found in zip(spans, values, best):
            low, high = (first + (1 << k) - 1) >> k, past >> k
            odd_low, odd_high = np.flatnonzero((low < high) & (low & 1 == 1)), np.flatnonzero((low < high) & (high & 1 == 1))
            told = np.concatenate([odd_low, odd_high])
            told_slots = np.concatenate([low[odd_low], high[odd_high] - 1])
            spoken = np.zeros((len(spots) >> k) + 2, bool)
            spoken[told_slots] = True
            heard = np.flatnonzero(spoken[slots])
            if not len(heard):
                continue
            who = np.concatenate([told, heard + none])
            where = np.concatenate([told_slots, slots[heard]])
            order = np.argsort(where * marks + place[who])
            who, where = who[order], where[order]
            begins = np.ones(len(who), bool)
            begins[1:] = (where[1:] != where[:-1]) | (band[who[1:]] != band[who[:-1]])
            shift = np.cumsum(begins) * (none + 1)
            said = np.full(len(who), none, np.int64)
            said[who < none] = value[who[who < none]]
            least = np.minimum.accumulate(said - shift) + shift
            asks = who >= none
            found[who[asks] - none] = np.minimum(found[who[asks] - none], least[asks])
    return best


def _beneath(labels: pa.Table, regions: pa.Table) -> pa.Table:
    """Least (score, region_no, bottom) of every label of one page."""
    center, y = labels["center"].to_numpy(), labels["y"].to_numpy()
    numbers = regions["region_no"].to_numpy()
    left, right, bottom, reach = (regions[c].to_numpy().astype(float) for c in ("left", "right", "bottom", "reach"))
    by_center = np.argsort(center, kind="stable")
    spots = np.empty(len(center), np.int64)
    spots[by_center] = np.arange(len(center))
    ends = [
        np.searchsorted(center[by_center], edge, side=side)
        for edge, side in ((left - reach, "left"), (left, "left"), (right, "right"), (right + reach, "right"))
    ]
    spans = list(zip(ends[:-1], ends[1:]))
    # what the region itself, and the label, add to the horizontal distance on each span
    own, theirs = (left, np.zeros(len(left)), -right), (-center, np.zeros(len(center)), center)
    score, number, low = np.full(len(y), np.inf), np.zeros(len(y), numbers.dtype), np.zeros(len(y))
    # regions that end above the label; then those that end below it, in its band and in the next one
    for sign, height, banded, reverse in ((-1, 0.0, False, False), (1, 0.0, True, True), (1, OVERLAP, True, False)):
        says = [add + sign * bottom for add in own]
        ordered_by = [np.lexsort((bottom, numbers, said)) for said in says]
        values = []
        for at in ordered_by:
            value = np.empty(len(at), np.int64)
            value[at] = np.arange(len(at))
            values.append(value)
        for found, at, said, add in zip(_walk(spots, y + height, bottom, spans, values, banded, reverse), ordered_by, says, theirs):
            hit = np.flatnonzero(found < len(bottom))
            region = at[found[hit]]
            new, no, below = said[region] + add[hit] - sign * y[hit], numbers[region], bottom[region]
            same = new == score[hit]
            better = (new < score[hit]) | (same & ((no < number[hit]) | ((no == number[hit]) & (below < low[hit]))))
            hit, new, no, below = hit[better], new[better], no[better], below[better]
            score[hit], number[hit], low[hit] = new, no, below
    got = np.flatnonzero(np.isfinite(score))
    out = labels.select(["page", "label_id", "y"]).take(pa.array(got))
    for name, column in (("score", score), ("region_no", number), ("bottom", low)):
        out = out.append_column(name, pa.array(column[got]))
    return out


def nearest_regions(labels: DataFrame, regions: DataFrame) -> DataFrame:
    """The image region of each label: the least sum of vertical and horizontal distance, without pairs.

    ``labels`` has page, label_id, center and y; ``regions`` has page, region_no, left, right, top and
    bottom. A region counts if both sides are long enough, it ends at most ``OVERLAP`` below the label's
    y, and the center is within its reach. Ties go to the smaller region_no. If the nearest region is
    more than ``MAX_HEIGHT`` away in height, or there is none, region_no is null.

    A region's reach falls into three spans of x (left of it, across, right of it), and on each the
    distance is a value of the region plus a value of the label. Spans are covered by power-of-two ranges
    of center ranks; within a range regions and labels walk down the page together, and a running least
    value answers each label. One task does so for a page; pages too large for that go through
    :func:`ranked_regions`. Labels of pages without regions, and regions without labels, are not moved.
    """
    usable = regions.where(
        f"right - left >= {LEAST_SIDE} and bottom - top >= {LEAST_SIDE} and page is not null and region_no is not null"
    ).select(
        "page", "region_no", "left", "right", "bottom",
        F.greatest(F.lit(LEAST_REACH), (F.col("right") - F.col("left")) * REACH_SHARE).alias("reach"),
    )
    centers = labels.select(
        "page", "label_id", F.col("center").cast("double").alias("center"), F.col("y").cast("double").alias("y")
    ).dropna()
    centers = settle(centers.join(usable.select("page").distinct(), "page", "left_semi"))
    usable = settle(usable.join(centers.select("page").distinct(), "page", "left_semi"))
    hot = _parted(centers.select("page").unionByName(usable.select("page")), ["page"], PAGE_PLACES)
    here, told = centers, usable
    if hot is not None:
        here, told = centers.join(hot, "page", "left_anti"), usable.join(hot, "page", "left_anti")
    kinds = dict(labels.dtypes) | {"region_no": dict(regions.dtypes)["region_no"]}
    found = here.groupBy("page").cogroup(told.groupBy("page")).applyInArrow(
        lambda labels, regions: _beneath(labels, regions),
        f"page {kinds['page']}, label_id {kinds['label_id']}, y double, score double, region_no {kinds['region_no']}, bottom double",
    ).select("page", "label_id", "y", F.struct("score", "region_no", "bottom").alias("best"))
    if hot is not None:
        found = found.unionByName(
            ranked_regions(centers.join(hot, "page", "left_semi"), usable.join(hot, "page", "left_semi"))
        )
    best = found.groupBy("page", "label_id").agg(F.min("best").alias("best"), F.max("y").alias("y"))
    near = best.where(F.abs(F.col("y") - F.col("best.bottom")) <= MAX_HEIGHT)
    return labels.join(near.select("page", "label_id", "best.region_no"), ["page", "label_id"], "left")


def ranked_regions(centers: DataFrame, usable: DataFrame) -> DataFrame:
    """Answers of :func:`nearest_regions`, one per walk and label, for pages of any size."""
    edges = usable.select(
        "page", F.col("region_no").alias("label_id"),
        F.expr(
            "explode(array(struct(left - reach as at, -1 as kind, 1 as edge), struct(left as at, -1 as kind, 2 as edge), "
            "struct(right as at, 1 as kind, 3 as edge), struct(right + reach as at, 1 as kind, 4 as edge))) as e"
        ),
    ).select("page", "label_id", "e.*")
    events = edges.unionByName(
        centers.select("page", "label_id", F.col("center").alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("edge"))
    )
    passed = {"_passed": Running("sum", (F.col("kind") == 0).cast("long"))}
    counted = settle(running(events, ["page"], ["at", "kind", "label_id"], _places("at", "kind"), passed))
    tops = _top_levels(centers)
    where = ["page", "level", "slot"]
    asks = (
        centers.join(counted.where("edge = 0").selectExpr("page", "label_id", "_passed - 1 as rank"), ["page", "label_id"])
        .join(tops, "page")
        .selectExpr("page", "label_id", "center", "y", SLOTS_AROUND)
        .select("page", "s.level", "s.slot", "label_id", "center", "y")
    )
    edge = [F.max(F.when(F.col("edge") == i, F.col("_passed"))).alias(f"_edge{i}") for i in (1, 2, 3, 4)]
    ranges = counted.where("edge > 0").groupBy("page", F.col("label_id").alias("region_no")).agg(*edge)
    sides = "explode(array({})) as r".format(
        ", ".join(
            f"struct({n} as side, coalesce(_edge{n}, 0L) as first, coalesce(_edge{n + 1}, 0L) as past)" for n in (1, 2, 3)
        )
    )
    # what the region itself adds to the horizontal distance on each of its sides
    own = {1: F.col("left"), 2: F.lit(0.0), 3: -F.col("right")}
    speakers = (
        usable.join(ranges, ["page", "region_no"])
        .selectExpr("page", "region_no", "left", "right", "bottom", sides)
        .select("page", "region_no", "left", "right", "bottom", "r.*")
        .join(tops, "page")
        .selectExpr("page", "region_no", "left", "right", "bottom", "side", SLOTS_OF_RANGE)
    )

    def said(sign: int) -> list:
        return [
            F.when(
                F.col("side") == n, F.struct((add + sign * F.col("bottom")).alias("score"), "region_no", "bottom")
            ).alias(f"_side{n}")
            for n, add in own.items()
        ]

    def walk(sign: int, height: float, banded: bool, reverse: bool) -> DataFrame:
        told = speakers.select(
            "page", "s.level", "s.slot", F.col("bottom").alias("at"), F.lit(0).alias("kind"),
            F.col("region_no").alias("label_id"), *said(sign),
        )
        heard = asks.select(
            *where, (F.col("y") + height).alias("at"), F.lit(1).alias("kind"), "label_id", "center", "y"
        )
        both = told.unionByName(heard, allowMissingColumns=True)
        keys = where + ["band"] if banded else where
        if banded:
            both = both.withColumn("band", F.floor(F.col("at") / OVERLAP))
        outs = {f"_side{n}": Running("min", F.col(f"_side{n}")) for n in own}
        found = running(settle(both), keys, ["at", "kind", "label_id"], _places("at", "kind"), outs, reverse)
        of_label = {1: -F.col("center"), 2: F.lit(0.0), 3: F.col("center")}
        scored = [
            F.when(
                F.col(f"_side{n}").isNotNull(),
                F.struct(
                    (F.col(f"_side{n}.score") + of_label[n] - sign * F.col("y")).alias("score"),
                    F.col(f"_side{n}.region_no").alias("region_no"), F.col(f"_side{n}.bottom").alias("bottom"),
                ),
            )
            for n in own
        ]
        return found.where("kind = 1").select("page", "label_id", "y", F.least(*scored).alias("best"))

    # regions that end above the label; then those that end below it, in its band and in the next one
    above = walk(-1, 0.0, False, False)
    below = walk(1, 0.0, True, True).unionByName(walk(1, OVERLAP, True, False))
    return above.unionByName(below)
