"""Ordered work inside groups that may be far too large for one task.

A plain ``row_number() over (partition by doc order by ...)`` sends a whole group to one task. When
one document holds a third of all rows that task never ends. So the group sizes are measured first: a
count per key, which reads the key columns only and combines on the map side. If no group exceeds
``HOT_ROWS``, a plain window does the work. Otherwise it is done in two steps. Rows are windowed inside
*blocks* of a group (a block is a coarse, order-preserving value such as the minute of a timestamp or
``row_no div 2^20``), one summary row per block is scanned inside the group, and the prefix of the
earlier blocks is joined back. The block is computed from the row's own values, so a retried task
gives the same answer.

Null keys form a group and null order values come first, in blocks as in a plain window.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 20
#: largest group that one task may window on its own; tests set 0 to walk in blocks always
HOT_ROWS = int(os.environ.get("FOLIOFLOW_HOT_ROWS", 1 << 20))


def number_blocks(col: str, width: int = BLOCK_ROWS) -> list[Column]:
    """Blocks for an integral order column that is unique within its group."""
    return [F.expr(f"`{col}` div {width}")]


def time_blocks(col: str, grain: str = "minute") -> list[Column]:
    """Blocks for a timestamp order column."""
    return [F.date_trunc(grain, F.col(col))]


def dated_blocks(time_col: str, id_col: str, width: int = BLOCK_ROWS) -> list[Column]:
    """Blocks for rows ordered by a timestamp, coarse or fine, and then a unique id."""
    time = F.col(time_col)
    return [F.date_trunc("day", time), F.date_trunc("minute", time), time, F.expr(f"`{id_col}` div {width}")]


def name_blocks(col: str) -> list[Column]:
    """Blocks for a string order column: beginnings of growing length, then the whole string."""
    return [*[F.substring(col, 1, size) for size in (1, 2, 4, 8, 16)], F.col(col)]


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is count, sum, min, max or last (last skips nulls)."""

    kind: str
    value: Column | None = None
    #: keep the row itself out of its own running value
    exclusive: bool = False


def _local(run: Running, window) -> Column:
    if run.kind == "count":
        return F.count(F.lit(1)).over(window)
    fn = {"sum": F.sum, "min": F.min, "max": F.max}.get(run.kind)
    if fn is not None:
        return fn(run.value).over(window)
    return F.last(run.value, ignorenulls=True).over(window)


def _frame(window, run: Running):
    return window.rowsBetween(Window.unboundedPreceding, -1 if run.exclusive else 0)


def _block_total(run: Running, order: Sequence[str], reverse: bool) -> Column:
    if run.kind == "count":
        return F.count(F.lit(1))
    fn = {"sum": F.sum, "min": F.min, "max": F.max}.get(run.kind)
    if fn is not None:
        return fn(run.value)
    newest = F.min_by if reverse else F.max_by
    return newest(run.value, F.when(run.value.isNotNull(), F.struct(*order)))


def _merge(run: Running, before: Column, here: Column) -> Column:
    if run.kind == "count" or run.kind == "sum":
        # null + null stays null for a sum over no rows
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    if run.kind == "min":
        return F.least(before, here)
    if run.kind == "max":
        return F.greatest(before, here)
    return F.coalesce(here, before)


def _sorted(cols: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in cols]


def _same_group(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join on ``cols`` where null meets null, as it does in a window."""
    named = right.select(*[F.col(c).alias(f"_right_{c}") if c in cols else F.col(c) for c in right.columns])
    match = reduce(lambda a, b: a & b, [left[c].eqNullSafe(named[f"_right_{c}"]) for c in cols])
    return left.join(named, match).drop(*[f"_right_{c}" for c in cols])


def _carry(
    blocks: DataFrame, keys: list[str], levels: list[str], outs: dict[str, Running], reverse: bool
) -> DataFrame:
    """For each block, the merged totals of all earlier blocks of its group."""
    outer = keys + levels[:-1]
    window = (
        Window.partitionBy(*outer)
        .orderBy(*_sorted(levels[-1:], reverse))
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def over_totals(run: Running, name: str) -> Running:
        return Running("sum" if run.kind == "count" else run.kind, F.col(name))

    totals = {name: over_totals(run, name) for name, run in outs.items()}
    here = blocks.select(
        *keys, *levels, *[_local(run, window).alias(name) for name, run in totals.items()]
    )
    if len(levels) == 1:
        return here
    parents = blocks.groupBy(*outer).agg(
        *[_block_total(run, levels[-1:], reverse).alias(name) for name, run in totals.items()]
    )
    above = _carry(parents, keys, levels[:-1], outs, reverse).select(
        *outer, *[F.col(name).alias(f"_above_{name}") for name in outs]
    )
    return _same_group(here, above, outer).select(
        *keys,
        *levels,
        *[_merge(run, F.col(f"_above_{name}"), F.col(name)).alias(name) for name, run in totals.items()],
    )


def has_hot_group(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """Does any group hold more rows than ``limit``? The driver sees one row at most."""
    if HOT_ROWS <= 0:
        return True
    most = HOT_ROWS if limit is None else min(limit, HOT_ROWS)
    return not df.groupBy(*keys).count().where(F.col("count") > most).limit(1).isEmpty()


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    blocks: Sequence[Column],
    outs: dict[str, Running],
    reverse: bool = False,
    in_blocks: bool = False,
) -> DataFrame:
    """Add running values per group in the given order.

    ``order`` must be unique within a group; ``blocks`` are order-preserving, coarse to fine.
    ``reverse`` walks the group from its end; ``in_blocks`` walks in blocks whatever the sizes.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in outs]
    if not in_blocks and not has_hot_group(df, keys):
        whole = Window.partitionBy(*keys).orderBy(*_sorted(order, reverse))
        return df.select(*rest, *[_local(run, _frame(whole, run)).alias(n) for n, run in outs.items()])
    levels = [f"_block{i}" for i in range(len(blocks))]
    placed = df.select("*", *[b.alias(n) for b, n in zip(blocks, levels)])
    base = Window.partitionBy(*keys, *levels).orderBy(*_sorted(order, reverse))
    local = placed.select(
        "*",
        *[
            _local(run, _frame(base, run)).alias(f"_here_{name}")
            for name, run in outs.items()
        ],
    )
    totals = placed.groupBy(*keys, *levels).agg(
        *[_block_total(run, order, reverse).alias(name) for name, run in outs.items()]
    )
    carried = _carry(totals, keys, levels, outs, reverse).select(
        *keys, *levels, *[F.col(name).alias(f"_before_{name}") for name in outs]
    )
    joined = _same_group(local, carried, keys + levels)
    return joined.select(
        *rest,
        *[
            _merge(run, F.col(f"_before_{name}"), F.col(f"_here_{name}")).alias(name)
            for name, run in outs.items()
        ],
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    blocks: Sequence[Column],
    out: str = "row_no",
    start: int = 1,
    reverse: bool = False,
) -> DataFrame:
    """Number the rows of each group in order, beginning at ``start``."""
    counted = running(df, keys, order, blocks, {out: Running("count")}, reverse)
    return counted if start == 1 else counted.withColumn(out, F.col(out) + F.lit(start - 1))


def carried(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    blocks: Sequence[Column],
    values: dict[str, Column],
) -> DataFrame:
    """Forward fill: each value is the last one that was not null, the row's own included."""
    return running(df, keys, order, blocks, {n: Running("last", v) for n, v in values.items()})


def first_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], last: bool = False
) -> DataFrame:
    """Keep the first (or last) row per key. An aggregate, so hot keys combine on the map side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_kept"))
    return kept.select(*keys, "_kept.*")


def gathered(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: dict[str, Column],
    per_part: int = 1000,
) -> DataFrame:
    """Collect ordered arrays per group in parts of at most ``per_part`` elements.

    ``position`` numbers the rows of a group from 1 (see :func:`numbered`). A group of ordinary size
    gives one row with ``part_no`` 0; a huge one gives several rows and loses nothing.
    """
    part = F.floor((F.col(position) - 1) / F.lit(per_part)).cast("long").alias("part_no")
    item = F.struct(F.col(position).alias("_at"), *[v.alias(n) for n, v in values.items()])
    packed = (
        df.select(*keys, part, item.alias("_item"))
        .groupBy(*keys, "part_no")
        .agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    )
    return packed.select(
        *keys,
        "part_no",
        *[F.col(f"_items.{name}").alias(name) for name in values],
    )


def collected(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    blocks: Sequence[Column],
    values: dict[str, Column],
    per_part: int = 1000,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Ordered arrays per group in parts of about ``per_part`` elements.

    When every group fits one part, arrays are collected and sorted in place; only longer groups need
    their rows numbered first. ``sizes`` is a cheaper table with the same groups to measure.
    """
    if has_hot_group(df if sizes is None else sizes, keys, per_part):
        placed = numbered(df, keys, order, blocks, out="_position")
        return gathered(placed, keys, "_position", values, per_part)
    item = F.struct(*order, *[v.alias(f"_value_{n}") for n, v in values.items()])
    packed = df.select(*keys, item.alias("_item")).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_item")).alias("_items")
    )
    return packed.select(
        *keys,
        F.lit(0).cast("long").alias("part_no"),
        *[F.col(f"_items._value_{n}").alias(n) for n in values],
    )
