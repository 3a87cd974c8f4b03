"""Nearest neighbours by a block matrix join of int8 products.

Vectors are dealt into blocks. A block holds its vectors as int8 codes with a scale each, the length of
each vector and of what rounding lost, and the vectors themselves. Every block of queries meets every
block of candidates of the same dimension: the product of the codes gives all inner products of the
tile within a proven error bound. Pairs whose upper bound stays below the query's k-th best lower bound
drop out; the others are computed in double precision. Heaps of k per query merge the tiles.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, stash

CANDIDATE_ROWS, QUERY_ROWS = 4096, 512

_BLOCK = {"ids": pa.binary(), "codes": pa.binary(), "scales": pa.binary(), "norms": pa.binary(), "lost": pa.binary(),
          "vectors": pa.binary()}
_FOUND = arrow_schema({"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()})


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: an id, finite numbers only, not all of them zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite).where(F.exists("v", lambda x: x != 0))


def quantised(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Codes, scales and the lengths that bound the products' error."""
    scales = np.abs(vectors).max(axis=1) / 127.0
    scales[scales == 0] = 1.0
    codes = np.rint(vectors / scales[:, None]).astype(np.int8)
    near = codes * scales[:, None]
    return {
        "ids": ids, "codes": codes, "scales": scales, "norms": np.sqrt((vectors * vectors).sum(axis=1)),
        "lost": np.sqrt(((vectors - near) ** 2).sum(axis=1)), "vectors": vectors,
    }


def blocks(vectors: DataFrame, rows: int, n_blocks: int, copies: int) -> DataFrame:
    """(dim, block, and the packed parts) from usable vectors, about ``rows`` in a block.

    Of equal vectors in a block only the ``copies`` smallest ids stay: no more of them can be among the
    nearest of any query. 0 keeps all.
    """
    placed = vectors.dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    )
    grouped = placed.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    schema = arrow_schema({"dim": pa.int32(), "block": pa.int32(), **_BLOCK})

    def pack(batches):
        for batch in batches:
            for dim, block, members in zip(
                batch.column("dim").to_pylist(), batch.column("block").to_pylist(), batch.column("rows")
            ):
                held = members.values
                ids = held.field("vec_id").to_numpy()
                flat = held.field("v").flatten().to_numpy().reshape(-1, dim)
                order = np.argsort(ids, kind="stable")
                ids, flat = ids[order], np.ascontiguousarray(flat[order])
                if copies:
                    same = np.unique(flat.view(f"V{8 * dim}").ravel(), return_inverse=True)[1]
                    by = np.argsort(same, kind="stable")
                    first = np.searchsorted(same[by], same[by])
                    keep = np.sort(by[np.arange(len(by)) - first < copies])
                    ids, flat = ids[keep], flat[keep]
                parts = quantised(ids, flat)
                yield batch_of(schema, [[dim], [block], *[[parts[name].tobytes()] for name in _BLOCK]])

    columns = ", ".join(f"{name} binary" for name in _BLOCK)
    return grouped.mapInArrow(pack, f"dim int, block int, {columns}")


def _unpacked(row: dict, dim: int) -> dict[str, np.ndarray]:
    kinds = {"ids": np.int64, "codes": np.int8}
    parts = {name: np.frombuffer(row[name], kinds.get(name, np.float64)) for name in _BLOCK}
    return parts | {name: parts[name].reshape(-1, dim) for name in ("codes", "vectors")}


def tile(q: dict[str, np.ndarray], c: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best in the tile, by exact score and smaller id."""
    # whole numbers below 2^24 are exact in single precision up to this many dimensions
    kind = np.float32 if q["codes"].shape[1] <= 1040 else np.float64
    products = (q["codes"].astype(kind) @ c["codes"].astype(kind).T).astype(np.float64)
    near = products * q["scales"][:, None] * c["scales"][None, :]
    reach = q["norms"] + q["lost"]
    bound = q["lost"][:, None] * (c["norms"] + c["lost"])[None, :] + reach[:, None] * c["lost"][None, :]
    bound += 1e-9 * reach[:, None] * c["norms"][None, :]
    own = q["ids"][:, None] == c["ids"][None, :]
    low = np.where(own | np.isnan(near - bound), -np.inf, near - bound)
    if low.shape[1] > k:
        least = np.partition(low, -k, axis=1)[:, -k]
    else:
        least = np.full(len(low), -np.inf)
    rows, cols = np.nonzero(~own & ~(near + bound < least[:, None]))
    scores = np.empty(len(rows))
    for at in range(0, len(rows), 1 << 16):
        part = slice(at, at + (1 << 16))
        scores[part] = (q["vectors"][rows[part]] * c["vectors"][cols[part]]).sum(axis=1)
    order = np.lexsort((c["ids"][cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return q["ids"][rows[keep]], c["ids"][cols[keep]], scores[keep]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product, ties to the smaller id.

    Queries are the vectors whose id is divisible by ``every``; candidates are all vectors but those with
    the query's own id and those of another dimension. The search is exact. Vectors without an id, null,
    empty, zero, or with null or non-finite components take no part; repeated rows count once; an empty
    table gives no rows. Other columns are not looked at.
    """
    able = usable(vectors)
    n = able.count()
    n_candidates, n_queries = -(-n // CANDIDATE_ROWS) or 1, -(-n // (every * QUERY_ROWS)) or 1
    candidates = stash(blocks(able, CANDIDATE_ROWS, n_candidates, k + 1), "candidates")
    queries = stash(blocks(able.where(F.col("vec_id") % every == 0), QUERY_ROWS, n_queries, 0), "queries")
    asked = queries.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))).alias("block"),
        F.struct(F.col("block").alias("block"), *_BLOCK).alias("q"),
    )
    tiles = asked.join(candidates.select("dim", "block", F.struct(*_BLOCK).alias("c")), ["dim", "block"])

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row].as_py() for name in ("dim", "q", "c")}
                found = tile(_unpacked(one["q"], one["dim"]), _unpacked(one["c"], one["dim"]), k)
                yield batch_of(_FOUND, found)

    found = tiles.mapInArrow(work, "query_id long, vec_id long, score double")

    def merge(batches):
        last, heap = None, []

        def best():
            return [(last, -less, score) for score, less in sorted(heap, reverse=True)]

        for batch in batches:
            done = []
            for query_id, vec_id, score in zip(*(batch.column(f.name).to_pylist() for f in _FOUND)):
                if query_id != last:
                    done.extend(best())
                    last, heap = query_id, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec_id))
                elif (score, -vec_id) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec_id))
            yield batch_of(_FOUND, list(zip(*done)) or [[]] * 3)
        yield batch_of(_FOUND, list(zip(*best())) or [[]] * 3)

    merged = found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(
        merge, "query_id long, vec_id long, score double"
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.select("query_id", F.row_number().over(ranked).alias("rank"), "vec_id", "score")
