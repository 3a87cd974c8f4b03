"""Whitening of embeddings by spectrum slicing.

The covariance is summed from exactly centred whole numbers. Its leading eigenvalues are found without a
full decomposition: the inertia of LDLᵀ of the covariance minus a shift counts the eigenvalues above the
shift (Sylvester), bisection on counts isolates each leading one, Rayleigh quotient iteration finishes it
in a few cubically converging steps, and two more counts certify its number.

Rows are packed into blocks without a shuffle. Sums over all rows are partial sums per task that combine
by dimension; only matrices whose size depends on the vectors' length ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, stash

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
#: eigenvalues below this share of the largest are nothing but rounding
NULL_SHARE = 1e-11
#: models of dimensions that sum up to this are broadcast (16 MB of vectors at 32 components); more are joined with salt
BROADCAST_DIMS, SALTS = 1 << 16, 64
#: numbers that a task's partial matrices hold before they are passed on
HELD_NUMBERS = 1 << 22

_BLOCK = arrow_schema({"dim": pa.int32(), "salt": pa.int32(), "ids": pa.list_(pa.int64()), "x": pa.binary()})
_SUMS = arrow_schema({"dim": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.decimal128(38, 0))})
_PART = arrow_schema({"dim": pa.int32(), "line": pa.int32(), "task": pa.int64(), "part": pa.binary()})
_PART_DDL = "dim int, line int, task long, part binary"
_MODEL = arrow_schema({
    "dim": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.decimal128(38, 0)), "trace": pa.float64(),
    "values": pa.binary(), "vectors": pa.binary(),
})
_SPREAD = arrow_schema({"dim": pa.int32(), "task": pa.int64(), "n": pa.int64(), "mean": pa.binary(), "moment": pa.binary()})
_OUT = arrow_schema({
    "vec_id": pa.int64(), "component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.float64(),
    "explained": pa.float64(), "identity_error": pa.float64(),
})


# -- one symmetric matrix --------------------------------------------------------------------

_ALPHA = (1 + 17**0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of LDLᵀ of the shifted matrix, by Bunch and Kaufman."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, above = len(a), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        own, double = abs(a[k, k]), False
        if k + 1 < n:
            below = np.abs(a[k + 1 :, k])
            r = int(below.argmax())
            most, r = float(below[r]), k + 1 + r
            if max(own, most) == 0.0:
                k += 1
                continue
            if own < _ALPHA * most:
                others = np.abs(a[r, k:])
                others[r - k] = 0.0
                widest = float(others.max())
                if own * widest >= _ALPHA * most * most:
                    pass
                elif abs(a[r, r]) >= _ALPHA * widest:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    double = True
        if double:
            # such a block always has one positive and one negative eigenvalue
            above += 1
            block, side = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= side @ np.linalg.solve(block, side.T)
            k += 2
        else:
            pivot = a[k, k]
            if pivot != 0.0:
                above += pivot > 0
                side = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(side, side / pivot)
            k += 1
    return above


@dataclass
class _Counts:
    """Counts of one matrix, each shift taken once; ``shifts`` rise while ``above`` falls."""

    matrix: np.ndarray
    shifts: list[float]
    above: list[int]

    def at(self, shift: float) -> int:
        found = int(np.searchsorted(self.shifts, shift))
        if found < len(self.shifts) and self.shifts[found] == shift:
            return self.above[found]
        value = count_above(self.matrix, shift)
        self.shifts.insert(found, shift)
        self.above.insert(found, value)
        return value

    def around(self, number: int) -> tuple[float, float]:
        """The narrowest known (low, high] that holds the eigenvalue of that number, from 1 downwards."""
        low = max(s for s, c in zip(self.shifts, self.above) if c >= number)
        high = min(s for s, c in zip(self.shifts, self.above) if c < number)
        return low, high


def _refined(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], number: int, scale: float):
    """Rayleigh quotient iteration inside (low, high], in the complement of the vectors found."""
    basis = np.array(found).reshape(-1, len(matrix))

    def apart(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
        return v / np.linalg.norm(v)

    v = apart(np.random.default_rng(number).standard_normal(len(matrix)))
    shift, eye, tiny = (low + high) / 2, np.eye(len(matrix)), 1e-15 * scale
    for step in range(60):
        try:
            grown = np.linalg.solve(matrix - shift * eye, v)
        except np.linalg.LinAlgError:
            shift += tiny
            continue
        if not np.isfinite(grown).all() or not grown.any():
            shift += tiny
            continue
        v = apart(grown / np.abs(grown).max())
        value = float(v @ matrix @ v)
        rest = float(np.linalg.norm(matrix @ v - value * v))
        if rest <= 4e-15 * scale and step:
            return value, v
        # inside the interval the quotient converges; outside it would leave for another eigenvalue
        shift = value if low <= value <= high and step > 1 else shift
    return value, v


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, with unit eigenvectors as rows; none that is only rounding.

    Raises ArithmeticError when the counts around an eigenvalue don't confirm its number.
    """
    n = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    if scale == 0.0:
        return np.empty(0), np.empty((0, n))
    counts = _Counts(matrix, [-scale * 1.01, scale * 1.01], [n, 0])
    values, vectors = [], []
    for number in range(1, min(most, n) + 1):
        low, high = counts.around(number)
        while True:
            # one alone in its interval, or a cluster that doubles can't tell apart
            while counts.at(low) - counts.at(high) > 1 and high - low > 1e-12 * scale:
                counts.at((low + high) / 2)
                low, high = counts.around(number)
            value, vector = _refined(matrix, low, high, vectors, number, scale)
            # these counts certify the number; where they don't, they narrow the interval
            margin = 1e-11 * scale
            if counts.at(value - margin) >= number > counts.at(value + margin):
                break
            if high - low <= 1e-12 * scale:
                raise ArithmeticError(f"eigenvalue {number} is not where it was found")
            counts.at((low + high) / 2)
            low, high = counts.around(number)
        if value <= NULL_SHARE * max(values[0] if values else value, scale / n):
            break
        values.append(value)
        vectors.append(vector * (1 if vector[np.abs(vector).argmax()] > 0 else -1))
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(-1, n)[order]


# -- all rows --------------------------------------------------------------------------------


def blocks(vectors: DataFrame) -> DataFrame:
    """Usable vectors as whole numbers, packed batch by batch: (dim, salt, ids, x)."""
    c = F.col("embedding").cast("array<double>")
    finite = F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float(1 << 55)))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c"))
    kept = kept.where(F.col("c").isNotNull() & (F.size("c") > 0)).where(finite)

    def pack(batches):
        salt = TaskContext.get().partitionId()
        for batch in batches:
            held = batch.column("c")
            sizes = held.value_lengths().to_numpy(zero_copy_only=False)
            ids = batch.column("vec_id")
            for dim in np.unique(sizes):
                rows = np.nonzero(sizes == dim)[0]
                flat = held.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                x = np.floor(SCALE * flat).astype(np.int64) + OFFSET
                salt += 1
                yield batch_of(_BLOCK, [
                    [int(dim)], [salt % SALTS], [ids.take(pa.array(rows)).to_pylist()], [x.astype("<i8").tobytes()],
                ])

    return kept.mapInArrow(pack, "dim int, salt int, ids array<long>, x binary")


def _numbers(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(-1, dim)


def _safe(x: np.ndarray, factor: int) -> np.ndarray:
    """``x`` as it is, or as Python's whole numbers where ``factor`` times it could pass 64 bits."""
    return x if int(np.abs(x).max(initial=0)) * max(factor, 1) < 1 << 62 else x.astype(object)


def sums(packed: DataFrame) -> DataFrame:
    """(dim, n, sums): rows and exact sums of every place, for each length of vectors."""

    def part(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("x").to_pylist()):
                x = _numbers(raw, dim)
                held = found.setdefault(dim, [0, [0] * dim])
                held[0] += len(x)
                held[1] = [a + int(b) for a, b in zip(held[1], _safe(x, len(x)).sum(axis=0))]
        yield batch_of(_SUMS, [list(found), [v[0] for v in found.values()], [v[1] for v in found.values()]])

    def merge(batches):
        last, n, total = None, 0, []
        for batch in batches:
            done: list[list] = [[], [], []]
            for dim, rows, values in zip(*(batch.column(f.name).to_pylist() for f in _SUMS)):
                if dim != last:
                    if last is not None:
                        for column, value in zip(done, (last, n, total)):
                            column.append(value)
                    last, n, total = dim, 0, [0] * dim
                n, total = n + rows, [a + int(b) for a, b in zip(total, values)]
            yield batch_of(_SUMS, done)
        if last is not None:
            yield batch_of(_SUMS, [[last], [n], [total]])

    ddl = "dim int, n long, sums array<decimal(38,0)>"
    parts = packed.mapInArrow(part, ddl)
    return parts.repartition("dim").sortWithinPartitions("dim").mapInArrow(merge, ddl)


def _beside(packed: DataFrame, model: DataFrame) -> DataFrame:
    """Every block with the row of its dimension; one dimension may hold all blocks."""
    if (model.agg(F.sum("dim")).first()[0] or 0) <= BROADCAST_DIMS:
        return packed.join(F.broadcast(model), "dim")
    salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return packed.join(salted, ["dim", "salt"])


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - sums) in whole numbers, and that over n."""
    apart = _safe(x, 2 * n) * n - total[None, :]
    return apart, apart.astype(np.float64) / n


def _totals(values: list) -> np.ndarray:
    whole = [int(v) for v in values]
    return np.array(whole, np.int64 if max(map(abs, whole), default=0) < 1 << 62 else object)


def _matrix_parts(beside: DataFrame) -> DataFrame:
    """Lines of the tasks' partial sums of centred products."""

    def work(batches):
        task, held, size = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                y = _centred(_numbers(row["x"], dim), row["n"], _totals(row["sums"]))[1]
                if dim not in held:
                    held[dim], size = np.zeros((dim, dim)), size + dim * dim
                held[dim] += y.T @ y
                if size > HELD_NUMBERS:
                    for d, m in held.items():
                        yield from _lines(d, m, task)
                    task, held, size = task + 1, {}, 0
        for d, m in held.items():
            yield from _lines(d, m, task)

    return beside.mapInArrow(work, _PART_DDL)


def _lines(dim: int, matrix: np.ndarray, task: int) -> Iterator[pa.RecordBatch]:
    yield batch_of(_PART, [[dim] * dim, list(range(dim)), [task] * dim, [line.tobytes() for line in matrix]])


def _added(parts: DataFrame) -> DataFrame:
    """Partial lines summed per (dim, line), in the tasks' order, so that the sum is the same each time."""

    def work(batches):
        last, total = None, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for dim, line, _, raw in zip(*(batch.column(f.name).to_pylist() for f in _PART)):
                if (dim, line) != last:
                    if last is not None:
                        for column, value in zip(out, (*last, 0, total.tobytes())):
                            column.append(value)
                    last, total = (dim, line), np.zeros(dim)
                total = total + np.frombuffer(raw)
            yield batch_of(_PART, out)
        if last is not None:
            yield batch_of(_PART, [[last[0]], [last[1]], [0], [total.tobytes()]])

    dealt = parts.repartition("dim", "line").sortWithinPartitions("dim", "line", "task")
    return dealt.mapInArrow(work, _PART_DDL)


def fit(packed: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(dim, n, sums, trace, values, vectors): one row for each length of vectors."""
    totals = stash(sums(packed), "sums")
    lines = _added(_matrix_parts(_beside(packed, totals)))
    # a matrix is as large as the vectors are long, however many rows there are
    whole = lines.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("line", "part"))).alias("lines"))

    def solve(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = np.array([np.frombuffer(p["part"]) for p in row["lines"]]) / row["n"]
                matrix = (matrix + matrix.T) / 2
                values, vectors = leading(matrix, components)
                yield batch_of(_MODEL, [
                    [row["dim"]], [row["n"]], [row["sums"]], [float(np.trace(matrix))], [values.tobytes()],
                    [vectors.tobytes()],
                ])

    ddl = "dim int, n long, sums array<decimal(38,0)>, trace double, values binary, vectors binary"
    return stash(whole.join(totals, "dim").mapInArrow(solve, ddl), "spectrum")


def _whitened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole-number deviations, whitened rows and eigenvalues of a block."""
    apart, y = _centred(_numbers(row["x"], row["dim"]), row["n"], _totals(row["sums"]))
    values = np.frombuffer(row["values"])
    vectors = np.frombuffer(row["vectors"]).reshape(len(values), row["dim"])
    return apart, (y @ vectors.T) / np.sqrt(values), values


def _joined(a: tuple | None, b: tuple) -> tuple:
    """Counts, means and centred second moments of two parts as those of both."""
    if a is None:
        return b
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def identity_errors(beside: DataFrame) -> DataFrame:
    """(dim, identity_error): the whitened rows' covariance minus the identity, its largest absolute entry."""
    ddl = "dim int, task long, n long, mean binary, moment binary"

    def part(batches):
        task, found = TaskContext.get().partitionId(), {}
        for batch in batches:
            for row in batch.to_pylist():
                w = _whitened(row)[1]
                mean = w.mean(axis=0)
                found[row["dim"]] = _joined(found.get(row["dim"]), (len(w), mean, (w - mean).T @ (w - mean)))
        yield batch_of(_SPREAD, [
            list(found), [task] * len(found), [v[0] for v in found.values()],
            [v[1].tobytes() for v in found.values()], [v[2].tobytes() for v in found.values()],
        ])

    schema = arrow_schema({"dim": pa.int32(), "identity_error": pa.float64()})

    def merge(batches):
        last, held = None, None
        for batch in batches:
            for dim, _, n, mean, moment in zip(*(batch.column(f.name).to_pylist() for f in _SPREAD)):
                if dim != last and last is not None:
                    yield batch_of(schema, [[last], [_error(held)]])
                    held = None
                mean = np.frombuffer(mean)
                last, held = dim, _joined(held, (n, mean, np.frombuffer(moment).reshape(len(mean), len(mean))))
        if last is not None:
            yield batch_of(schema, [[last], [_error(held)]])

    parts = beside.mapInArrow(part, ddl)
    return parts.repartition("dim").sortWithinPartitions("dim", "task").mapInArrow(merge, "dim int, identity_error double")


def _error(held: tuple) -> float:
    n, _, moment = held
    return float(np.abs(moment / n - np.eye(len(moment))).max(initial=0.0))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row.

    A row takes part when its vector is not null or empty and holds finite numbers only, small enough
    (below 2^55) that 64 times each fits a long. Vectors of different lengths are different fit lists.
    ``component`` runs from 1 over the leading ``components`` eigenvalues; those that are zero up to
    rounding (equal rows, linear dependence) can't be whitened and have no rows. Ties of eigenvalues
    take one basis for all rows. A deviation beyond 64 bits is null. Repeated rows count as often as they
    occur, a null vec_id stays null, an empty table gives no rows, other columns are not looked at.
    """
    packed = stash(blocks(vectors), "blocks")
    beside = _beside(packed, fit(packed, components))
    errors = stash(identity_errors(beside), "errors")

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                apart, w, values = _whitened(row)
                k, rows = len(values), len(w)
                apart = _safe(apart, int(np.abs(apart).max(initial=0)) * row["dim"])
                far = [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(axis=1)]
                ids = pa.array(row["ids"], pa.int64())
                again = pa.array(np.repeat(np.arange(rows), k))
                yield batch_of(_OUT, [
                    ids.take(again), np.tile(np.arange(1, k + 1, dtype=np.int32), rows), np.full(rows * k, row["n"]),
                    pa.array(far, pa.int64()).take(again), w.ravel(), np.tile(values / row["trace"], rows),
                    np.full(rows * k, row["identity_error"]),
                ])

    return _beside(beside, errors).mapInArrow(
        work,
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
