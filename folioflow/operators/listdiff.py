"""Ordered comparison of two contents lists, a longest common subsequence in tiles.

The rows of both lists that stand at the same place from the beginning match at once, by a join, and
master rows whose key the manual lacks leave before: both is exact under the tie rule, which skips the
master's row first. Pairs of lists that are short then are matched in one task each. A long pair is cut
into tiles of ``TILE`` rows by ``TILE`` rows. A tile needs only the lengths on its lower and right border
and passes on those on its upper and left one, so all tiles of an anti-diagonal, of all maps, are
computed at a time, spread over the cluster, and their borders are written to the shared folder. Then
the path is followed from the beginning, a tile of every map at a time, each computed again from its
borders. No task holds more than a tile of a long pair.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, shared_folder
from .ordered import number_blocks, numbered

#: rows of a list in one tile
TILE = 1024
#: a pair with no more cells than this is matched whole
WHOLE_CELLS = 1 << 24


# -- one pair of lists -----------------------------------------------------------------------


def _above(row: np.ndarray, same: np.ndarray, last: int) -> np.ndarray:
    """Lengths of the row above ``row``; ``last`` is the length at its right end."""
    best = row.copy()
    best[-1] = last
    best[:-1][same] = row[1:][same] + 1
    return np.maximum.accumulate(best[::-1])[::-1]


def _rows(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths of the longest common subsequence of left[i:] and right[j:], last row first."""
    row = np.zeros(len(right) + 1, dtype=np.int32)
    yield len(left), row
    for i in range(len(left) - 1, -1, -1):
        row = _above(row, right == left[i], 0)
        yield i, row


def common_order(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Matched positions; on a tie the left row is skipped first.

    Rows are kept at intervals and rebuilt in between, so memory grows with len(right) * sqrt(len(left)).
    """
    n, m = len(left), len(right)
    step = max(1, math.isqrt(n))
    kept = {i: row for i, row in _rows(left, right) if i % step == 0 or i == n}
    found, i, j = [], 0, 0
    rows: dict[int, np.ndarray] = {}
    while i < n and j < m:
        if i not in rows or i + 1 not in rows:
            end = min(n, (i // step + 1) * step)
            row = kept[end]
            rows = {end: row}
            for k in range(end - 1, i - 1, -1):
                row = rows[k] = _above(row, right == left[k], 0)
        if left[i] == right[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def tile_rows(left: np.ndarray, right: np.ndarray, lower: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """All lengths of a tile, from those on its lower border and on its right one (both with the corner)."""
    rows = np.empty((len(left) + 1, len(right) + 1), np.int32)
    rows[-1] = lower
    for i in range(len(left) - 1, -1, -1):
        rows[i] = _above(rows[i + 1], right == left[i], beside[i])
    return rows


def tile_path(
    left: np.ndarray, right: np.ndarray, rows: np.ndarray, i: int, j: int
) -> tuple[list[tuple[int, int]], int, int]:
    """Matches inside a tile from (i, j) on, and where the path leaves it."""
    found = []
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1, j] >= rows[i, j + 1]:
            i += 1
        else:
            j += 1
    return found, i, j


def _codes(left, right) -> tuple[np.ndarray, np.ndarray]:
    """Keys as numbers, equal ones alike."""
    codes, _ = pd.factorize(np.concatenate([np.asarray(left, object), np.asarray(right, object)]))
    return codes[: len(left)], codes[len(left) :]


# -- all pairs -------------------------------------------------------------------------------


def _placed(df: DataFrame) -> DataFrame:
    """Places from 0 in row order, per map."""
    return numbered(df, ["map_id"], ["row_no"], number_blocks("row_no"), out="at", start=0)


def _beginnings(master: DataFrame, manual: DataFrame) -> DataFrame:
    """(map_id, until): how many rows match from the beginning."""
    left = master.select("map_id", "at", F.col("key").alias("_left"))
    right = manual.select("map_id", "at", F.col("key").alias("_right"))
    both = left.join(right, ["map_id", "at"], "full")
    differs = F.when(~F.col("_left").eqNullSafe(F.col("_right")), F.col("at"))
    return both.groupBy("map_id").agg(F.coalesce(F.min(differs), F.max("at") + 1).alias("until"))


def _rest(df: DataFrame, begun: DataFrame) -> DataFrame:
    rest = df.join(begun, "map_id").where(F.col("at") >= F.col("until"))
    return rest.select("map_id", "row_no", "key", (F.col("at") - F.col("until")).alias("at"))


def _strips(df: DataFrame, width: int) -> DataFrame:
    """(map_id, strip, nos, keys): the rows of a list in strips of ``width``."""
    strip = F.expr(f"at div {width}").alias("strip")
    rows = F.array_sort(F.collect_list(F.struct("at", "row_no", "key"))).alias("_r")
    packed = df.groupBy("map_id", strip).agg(rows)
    return packed.select("map_id", "strip", F.col("_r.row_no").alias("nos"), F.col("_r.key").alias("keys"))


def _match_whole(master: DataFrame, manual: DataFrame) -> DataFrame:
    """Short pairs, each matched in one task; ``whole`` lists are single strips."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                pairs = common_order(*_codes(row.master_keys, row.manual_keys))
                if pairs:
                    yield _matched(row, pairs, 0)

    kind = dict(master.dtypes)["map_id"]
    left, right = (_strips(df, 1 << 40).drop("strip") for df in (master, manual))
    both = left.withColumnsRenamed({"nos": "master_nos", "keys": "master_keys"}).join(
        right.withColumnsRenamed({"nos": "manual_nos", "keys": "manual_keys"}), "map_id"
    )
    # a fixed number keeps the maps spread; small shuffles would be merged into one task
    pieces = int(master.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(pieces, "map_id").mapInPandas(match, f"map_id {kind}, master_no long, manual_no long")


def _matched(row, pairs: list[tuple[int, int]], state: int) -> pd.DataFrame:
    at, to = (list(x) for x in zip(*pairs))
    return pd.DataFrame(
        {"map_id": row.map_id, "master_no": np.asarray(row.master_nos)[at], "manual_no": np.asarray(row.manual_nos)[to]}
    )


class _Tiles:
    """The long pairs: strips of both lists, borders and the path, all in one folder."""

    def __init__(self, master: DataFrame, manual: DataFrame):
        self.spark = master.sparkSession
        self.kind = dict(master.dtypes)["map_id"]
        self.folder = f"{shared_folder(self.spark).rstrip('/')}/tiles-{uuid.uuid4().hex}"
        self.left = settle(_strips(master, TILE).withColumnsRenamed({"strip": "a", "nos": "master_nos", "keys": "left"}))
        self.right = settle(_strips(manual, TILE).withColumnsRenamed({"strip": "b", "nos": "manual_nos", "keys": "right"}))
        counted = [df.groupBy("map_id").agg(F.max(c).alias(f"last_{c}")) for df, c in ((self.left, "a"), (self.right, "b"))]
        self.sizes = settle(counted[0].join(counted[1], "map_id"))
        self.border_ddl = f"map_id {self.kind}, a long, b long, upper array<int>, before array<int>"
        self.path_ddl = (
            f"map_id {self.kind}, a long, b long, i int, j int, master_no array<long>, manual_no array<long>"
        )

    def _keep(self, df: DataFrame, name: str, ddl: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(ddl).parquet(f"{self.folder}/{name}")

    def _with_strips(self, tiles: DataFrame) -> DataFrame:
        return tiles.join(self.left, ["map_id", "a"]).join(self.right, ["map_id", "b"])

    def borders(self) -> list[DataFrame]:
        """The upper and left borders of all tiles, one table for each anti-diagonal from the end."""

        def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    left, right = _codes(row.left, row.right)
                    rows = tile_rows(left, right, *_given(row, len(left), len(right)))
                    yield pd.DataFrame(
                        {"map_id": [row.map_id], "a": [row.a], "b": [row.b], "upper": [rows[0]], "before": [rows[:, 0]]}
                    )

        last = self.sizes.agg(F.max(F.col("last_a") + F.col("last_b"))).first()[0]
        nothing = F.lit(None).cast("array<int>")
        tiles = self.sizes.select(
            "map_id", F.col("last_a").alias("a"), F.col("last_b").alias("b"), nothing.alias("lower"), nothing.alias("beside")
        )
        done: list[DataFrame] = []
        for diagonal in range((last if last is not None else -1) + 1):
            computed = self._with_strips(tiles).mapInPandas(compute, self.border_ddl)
            done.append(self._keep(computed, f"border={diagonal}", self.border_ddl))
            told = done[-1].select("map_id", F.inline(F.array(
                F.struct((F.col("a") - 1).alias("a"), "b", F.col("upper").alias("lower"), nothing.alias("beside")),
                F.struct("a", (F.col("b") - 1).alias("b"), nothing.alias("lower"), F.col("before").alias("beside")),
            )))
            tiles = told.where("a >= 0 and b >= 0").groupBy("map_id", "a", "b").agg(
                F.max("lower").alias("lower"), F.max("beside").alias("beside")
            )
        return done

    def path(self, borders: list[DataFrame]) -> DataFrame:
        """(map_id, master_no, manual_no) along the paths, a tile of every map at a time."""

        def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    left, right = _codes(row.left, row.right)
                    rows = tile_rows(left, right, *_given(row, len(left), len(right)))
                    found, i, j = tile_path(left, right, rows, row.i, row.j)
                    down, on = i == len(left), j == len(right)
                    yield pd.DataFrame({
                        "map_id": [row.map_id], "a": [row.a + down], "b": [row.b + on],
                        "i": [0 if down else i], "j": [0 if on else j],
                        "master_no": [np.asarray(row.master_nos)[[p for p, _ in found]].astype(np.int64)],
                        "manual_no": [np.asarray(row.manual_nos)[[p for _, p in found]].astype(np.int64)],
                    })

        zero = F.lit(0).cast("long")
        state = self.sizes.select("map_id", zero.alias("a"), zero.alias("b"), F.lit(0).alias("i"), F.lit(0).alias("j"))
        rounds = 0
        while borders and not state.limit(1).isEmpty():
            # the tile's lower border is the upper one of the tile below, the right one that of the tile behind
            far = self.sizes.select("map_id", (F.col("last_a") + F.col("last_b")).alias("_far"))
            here = state.join(far, "map_id").withColumn("_diagonal", F.col("_far") - F.col("a") - F.col("b") - 1)
            wanted = {r[0] for r in here.select("_diagonal").distinct().collect()}
            tables = [borders[k].withColumn("_diagonal", F.lit(k).cast("long")) for k in sorted(wanted) if k >= 0]
            known = self.spark.createDataFrame([], f"{self.border_ddl}, _diagonal long")
            for table in tables:
                known = known.unionByName(table)
            below = known.select("map_id", (F.col("a") - 1).alias("a"), "b", "_diagonal", F.col("upper").alias("lower"))
            behind = known.select("map_id", "a", (F.col("b") - 1).alias("b"), "_diagonal", F.col("before").alias("beside"))
            keys = ["map_id", "a", "b", "_diagonal"]
            tiles = here.join(below, keys, "left").join(behind, keys, "left")
            stepped = self._with_strips(tiles).mapInPandas(follow, self.path_ddl)
            done = self._keep(stepped, f"path/round={rounds}", self.path_ddl)
            state = done.join(self.sizes, "map_id").where("a <= last_a and b <= last_b").select("map_id", "a", "b", "i", "j")
            rounds += 1
        if not rounds:
            return self.spark.createDataFrame([], f"map_id {self.kind}, master_no long, manual_no long")
        walked = self.spark.read.schema(self.path_ddl).parquet(*[f"{self.folder}/path/round={k}" for k in range(rounds)])
        return walked.select("map_id", F.inline(F.arrays_zip("master_no", "manual_no")))


def _given(row, n_left: int, n_right: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower and the right border of a tile; at the lists' ends all lengths are 0."""
    lower = np.zeros(n_right + 1, np.int32) if row.lower is None else np.asarray(row.lower, np.int32)
    beside = np.zeros(n_left + 1, np.int32) if row.beside is None else np.asarray(row.beside, np.int32)
    return lower, beside


def match_lists(master: DataFrame, manual: DataFrame) -> DataFrame:
    """Rows of two lists matched in order: (map_id, master_no, manual_no).

    Both have (map_id, row_no, key); ``row_no`` orders the rows of a map. Rows of a map that only one
    list has match nothing, null keys don't match.
    """
    known = master.join(manual.select("map_id", "key").distinct(), ["map_id", "key"], "left_semi")
    left = settle(_placed(known.select("map_id", "row_no", "key")))
    right = settle(_placed(manual.select("map_id", "row_no", "key")))
    begun = settle(_beginnings(left, right))
    pairs = left.join(begun, "map_id").where("at < until").select("map_id", "at", F.col("row_no").alias("master_no")).join(
        right.select("map_id", "at", F.col("row_no").alias("manual_no")), ["map_id", "at"]
    )
    left, right = settle(_rest(left, begun)), settle(_rest(right, begun))
    sizes = [df.groupBy("map_id").agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "n"), (right, "m"))]
    long = settle(sizes[0].join(sizes[1], "map_id").where(F.col("n") * F.col("m") > WHOLE_CELLS).select("map_id"))
    short = [df.join(long, "map_id", "left_anti") for df in (left, right)]
    found = pairs.select("map_id", "master_no", "manual_no").unionByName(_match_whole(*short))
    if long.isEmpty():
        return found
    tiles = _Tiles(*[df.join(long, "map_id", "left_semi") for df in (left, right)])
    return found.unionByName(tiles.path(tiles.borders()))
