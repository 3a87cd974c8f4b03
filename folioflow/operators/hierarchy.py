"""Parent chains of any depth, by doubling: each round follows twice as many parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def folder_path(items: DataFrame, root: str) -> DataFrame:
    """Joined folder path of every item below ``root``: (id, parent_id, name) gives path and reached.

    Rounds stop when no further item reaches the root; what is left belongs elsewhere or to a loop,
    and has a null path. The driver only sees the number of open items.
    """
    state = items.select(
        "id",
        F.col("parent_id").alias("next"),
        F.array().cast("array<string>").alias("names"),
        "name",
    )
    open_before = None
    while True:
        state = settle(state)
        pending = state.where(F.col("next").isNotNull() & (F.col("next") != root)).count()
        if pending == 0 or pending == open_before:
            break
        open_before = pending
        up = state.select(
            F.col("id").alias("next"),
            F.col("next").alias("_beyond"),
            F.concat("names", F.array("name")).alias("_above"),
        )
        moved = state.join(up, "next", "left")
        at_root = F.col("next") == root
        state = moved.select(
            "id",
            F.when(at_root, F.col("next")).otherwise(F.col("_beyond")).alias("next"),
            F.when(at_root | F.col("_above").isNull(), F.col("names"))
            .otherwise(F.concat("_above", "names"))
            .alias("names"),
            "name",
        )
    reached = F.coalesce(F.col("next") == root, F.lit(False))
    found = state.select(
        "id", reached.alias("reached"), F.when(reached, F.array_join("names", "/")).alias("path")
    )
    return items.join(found, "id")


def chain_roots(items: DataFrame, scope: str, id_col: str, parent_col: str) -> DataFrame:
    """Add ``root`` and ``hops``: the topmost ancestor reached through rows that are all present.

    A row whose parent is absent is its own root. Rows on a loop of parents, and those below one, have no
    root: ``root`` and ``hops`` are null.
    """
    known = items.select(scope, F.col(id_col).alias(parent_col), F.lit(True).alias("_known"))
    state = items.join(known, [scope, parent_col], "left").select(
        scope,
        F.col(id_col).alias("_id"),
        F.when(F.col("_known"), F.col(parent_col)).alias("_up"),
        F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("hops"),
    )
    # reach doubles each round, so only rows that lead into a loop are open after that many
    rounds_left = items.count().bit_length() + 1
    while True:
        state = settle(state)
        above = state.select(
            scope, F.col("_id").alias("_up"), F.col("_up").alias("_next"), F.col("hops").alias("_more")
        ).where(F.col("_next").isNotNull())
        if state.join(above, [scope, "_up"], "left_semi").isEmpty():
            looped = None
            break
        if rounds_left == 0:
            looped = above.select(scope, "_up", F.lit(True).alias("_looped"))
            break
        rounds_left -= 1
        state = state.join(above, [scope, "_up"], "left").select(
            scope,
            "_id",
            F.coalesce("_next", "_up").alias("_up"),
            (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"),
        )
    root, hops = F.coalesce("_up", "_id"), F.col("hops")
    if looped is not None:
        state = state.join(looped, [scope, "_up"], "left")
        root, hops = [F.when(F.col("_looped").isNull(), c) for c in (root, hops)]
    found = state.select(scope, F.col("_id").alias(id_col), root.alias("root"), hops.alias("hops"))
    return items.join(found, [scope, id_col])
