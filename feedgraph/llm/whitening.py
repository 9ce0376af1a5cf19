"""Whitening of embeddings by a bidiagonal qd solver.

The covariance is never formed: tasks centre their rows exactly and reduce them, block by block, to the triangle R of a
QR decomposition; triangles are stacked and reduced again, 16 at a time, until one is left. R is as large as the
dimension squared, whatever the rows. Householder reflections make it bidiagonal, dqds steps with shifts find all squared
singular values to high relative accuracy, and each wanted direction comes from the twisted factorisation with the
smallest pivot; directions whose values lie close together are made orthogonal. Tasks then project their rows.

Defined results. Entries c become x = floor(64 c) + 1000000. Rows are left out whose vector is null or empty, holds null or
non-finite entries or ones beyond 2^33, or has another length than most vectors (of equally common lengths the
longest). Repeated rows count each. Directions without variance are left out, so a table may have fewer components than
asked for, and a table of equal vectors, one row or none has an empty result. deviation is null where it exceeds a long.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgraph.llm import kernel
from feedgraph.llm.scratch import Scratch

COMPONENTS, SCALE, OFFSET, LARGEST = 32, 64, 1_000_000, float(1 << 33)
BLOCK, FAN_IN = 2048, 16
EPS = np.finfo(np.float64).eps
TINY = 1e-290
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double"
TRIANGLE = "slot long, entries binary"
MOMENTS = "slot long, n long, mean binary, products binary"


# --- the small dense problem: at most dimension x dimension -------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal and superdiagonal of Householder's bidiagonal form of a square matrix, and the reflections (start, unit
    vector) from the right."""
    r = r.copy()
    d = len(r)
    right = []
    for k in range(d):
        v = _reflector(r[k:, k])
        r[k:, k:] -= 2.0 * np.outer(v, v @ r[k:, k:])
        if k < d - 2:
            v = _reflector(r[k, k + 1 :])
            r[k:, k + 1 :] -= 2.0 * np.outer(r[k:, k + 1 :] @ v, v)
            right.append((k + 1, v))
    return np.diagonal(r).copy(), np.diagonal(r, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector whose reflection maps x onto the first axis (zero: nothing to do)."""
    v = x.copy()
    norm = np.linalg.norm(v)
    if norm == 0:
        return v
    v[0] += np.copysign(norm, v[0])
    return v / np.linalg.norm(v)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the upper bidiagonal matrix.

    A step without shift gives the diagonal of the inverse, whose trace bounds the smallest value from below and whose
    largest entry from above; the next step takes a shift between them, and the lower one where a pivot turns negative."""
    largest = max(float(np.max(np.abs(diagonal), initial=0.0)), float(np.max(np.abs(above), initial=0.0)))
    if largest == 0:
        return np.zeros(len(diagonal))
    q, e = ((diagonal / largest) ** 2).tolist(), ((above / largest) ** 2).tolist()
    found: list[float] = []
    open_ = [([max(x, TINY) for x in q], e, 0.0)]
    tolerance = (EPS * 4) ** 2
    while open_:
        q, e, sigma = open_.pop()
        while True:
            while e and e[-1] <= tolerance * (sigma + q[-1]):
                found.append(sigma + q.pop())
                e.pop()
            if not e:
                found.append(sigma + q[0])
                break
            cut = next((k for k, x in enumerate(e) if x <= tolerance * (sigma + min(q[k], q[k + 1]))), None)
            if cut is not None:
                open_ += [(q[: cut + 1], e[:cut], sigma), (q[cut + 1 :], e[cut + 1 :], sigma)]
                break
            if q[0] < q[-1]:
                q.reverse()
                e.reverse()
            q, e, pivots = _qd_step(q, e, 0.0)
            low, high = 1.0 / sum(1.0 / max(p, TINY) for p in pivots), min(pivots)
            for shift in (low + 0.9 * (high - low), low * (1 - 1e-10)):
                stepped = _qd_step(q, e, shift)
                if stepped is not None:
                    q, e, _ = stepped
                    sigma += shift
                    break
    return np.sort(np.maximum(np.array(found), 0.0))[::-1] * largest * largest


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transformation: new q and e, and the pivots; None if the shift is above the smallest value."""
    d = q[0] - shift
    new_q, new_e, pivots = [], [], [d]
    for k in range(len(e)):
        if d < 0:
            return None
        total = max(d + e[k], TINY)
        ratio = q[k + 1] / total
        new_q.append(total)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
        pivots.append(d)
    if d < 0:
        return None
    return [*new_q, max(d, TINY)], new_e, pivots


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit right singular vector of the bidiagonal matrix B to a squared singular value: B'B - value = L D L', factored
    from the top and from the bottom, twisted together where the pivot is smallest."""
    low, pivot, up, at = _factors(diagonal, above, value)
    n = len(diagonal)
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -low[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def _factors(diagonal: np.ndarray, above: np.ndarray, value: float) -> tuple[list[float], list[float], list[float], int]:
    big = (diagonal * diagonal).tolist()
    n, least = len(big), EPS * EPS * max(value, TINY)  # in the place of a pivot that is zero
    ell = [float(b / a) if a != 0 else 0.0 for a, b in zip(diagonal, above, strict=False)]
    low, tops, pivots = [], [], []
    s = -value
    for k in range(n):
        tops.append(s)
        p = big[k] + s
        p = p if abs(p) > least else -least
        pivots.append(p)
        if k < n - 1:
            low.append(big[k] * ell[k] / p)
            s = low[k] * ell[k] * s - value
    up, bottoms = [0.0] * (n - 1), [0.0] * n
    p = big[-1] - value
    for k in range(n - 2, -1, -1):
        bottoms[k + 1] = p
        total = big[k] * ell[k] * ell[k] + p
        total = total if abs(total) > least else -least
        ratio = big[k] / total
        up[k] = ell[k] * ratio
        p = p * ratio - value
    bottoms[0] = p
    twists = [abs(tops[k] + bottoms[k] + value) for k in range(n)]
    return low, pivots, up, int(np.argmin(twists))


def _solve(low: list[float], pivots: list[float], right: np.ndarray) -> np.ndarray:
    """x with L D L' x = right."""
    x = right.copy()
    for k in range(len(low)):
        x[k + 1] -= low[k] * x[k]
    x /= pivots
    for k in range(len(low) - 1, -1, -1):
        x[k] -= low[k] * x[k + 1]
    return x


def directions(r: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, falling, and unit right singular vectors (rows) of a square matrix, as many as wanted
    and as have a value that is more than rounding."""
    diagonal, above, right = bidiagonal(r)
    scale = float(np.max(np.abs(r), initial=0.0))
    if scale == 0:
        return np.zeros(0), np.zeros((0, len(r)))
    diagonal, above = diagonal / scale, above / scale
    values, blocks = [], []
    bound = EPS * max(float(np.max(np.abs(diagonal))), float(np.max(np.abs(above), initial=0.0)))
    above = np.where(np.abs(above) <= bound * EPS, 0.0, above)
    diagonal = np.where(np.abs(diagonal) <= bound * EPS, bound * EPS, diagonal)
    edges = [0, *(np.flatnonzero(above == 0) + 1).tolist(), len(diagonal)]
    for start, stop in zip(edges[:-1], edges[1:], strict=True):  # an unreduced block at a time
        own = dqds(diagonal[start:stop], above[start : stop - 1])
        values += own.tolist()
        blocks += [(start, stop)] * len(own)
    order = np.argsort(-np.array(values), kind="stable")
    least = max(values) * (EPS * len(r)) ** 2 * 16
    chosen = [k for k in order.tolist() if values[k] > least][:wanted]
    rng = np.random.default_rng(0)
    vectors: list[np.ndarray] = []
    for at, k in enumerate(chosen):
        start, stop = blocks[k]
        d, a, value = diagonal[start:stop], above[start : stop - 1], values[k]
        near = [vectors[m][start:stop] for m in range(at) if blocks[chosen[m]] == (start, stop) and values[chosen[m]] - value <= 1e-3 * values[chosen[m]]]
        z = twisted_vector(d, a, value)
        own = _apart(z, near)
        tries = 0
        while near and np.linalg.norm(own) < 0.5 and tries < 8:  # too close to those before: inverse iteration among what is left
            low, pivots, _, _ = _factors(d, a, value * (1 + 2 * EPS))
            z = _apart(rng.standard_normal(len(d)), near)
            for _ in range(3):
                z = _apart(_solve(low, pivots, z / np.linalg.norm(z)), near)
            own, tries = z / np.linalg.norm(z), tries + 1
        whole = np.zeros(len(r))
        whole[start:stop] = own / np.linalg.norm(own)
        vectors.append(whole)
    out = np.array(vectors).reshape(len(chosen), len(r))
    for start, v in reversed(right):
        out[:, start:] -= 2.0 * np.outer(out[:, start:] @ v, v)
    return np.array([values[k] for k in chosen]) * scale * scale, out


def _apart(z: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in near:
            z = z - (z @ other) * other
    return z


# --- the table -----------------------------------------------------------------------------------------------------------


def usable() -> Column:
    """Vectors without null, non-finite or too large entries."""
    return F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)))


def fixed_point(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x of all rows to fit and whiten."""
    rows = vectors.select("vec_id", F.col(vector).cast("array<double>").alias("v")).where(usable())
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept = rows.where(F.size("v") == (length["d"] if length else 0))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _exact(x: np.ndarray, n: int, middle: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x - S / n, sum of (n x - S)^2 and whether it is exact), where S = n * middle + rest."""
    y = x - middle
    centred = y - rest / n
    rough = (centred * centred).sum(axis=1) * float(n) * float(n)
    within = (rough < 2.0**62) & (np.abs(y).max(axis=1) * float(n) < 2.0**61)
    whole = np.zeros(len(x), dtype=np.int64)
    scaled = y[within] * n - rest
    whole[within] = (scaled * scaled).sum(axis=1)
    return centred, (whole, within)


def _triangle(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """R of all blocks, one upon another."""
    r = None
    for block in blocks:
        r = np.linalg.qr(block if r is None else np.concatenate((r, block)), mode="r")
    return r


def combined(table: DataFrame, scratch: Scratch, name: str, merge: Callable[[pa.Table], pa.Table], schema: str) -> pa.Table:
    """The one row that is left when rows are merged by slots, FAN_IN at a time, level by level."""
    level = scratch.keep(table, f"{name}-0")
    width, k = level.agg(F.max("slot")).first()[0], 0
    while width:
        width, k = width // FAN_IN, k + 1
        level = scratch.keep(level.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("long")).groupBy("slot").applyInArrow(merge, schema), f"{name}-{k}")
    return level.toArrow()


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row for each vector and component."""
    from pyspark import TaskContext

    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = scratch.keep(fixed_point(vectors, vector), "rows")
    n = rows.count()
    empty = spark.createDataFrame([], f"{WHITENED}, identity_error double")
    if n < 2:
        return empty

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([_matrix(batch).sum(axis=0)], type=pa.list_(pa.int64()))})

    sums = rows.select("x").mapInArrow(partial, "sums array<long>").select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total = [int(r["s"]) for r in sorted(sums.collect(), key=lambda r: r["k"])]  # a row for each dimension
    middle = np.array([s // n for s in total], dtype=np.int64)
    rest = np.array([s % n for s in total], dtype=np.int64)
    d = len(total)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield _exact(_matrix(batch.slice(at, BLOCK)), n, middle, rest)[0]

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _triangle(blocks(batches))
        if r is not None:
            yield from kernel.batches(kernel.arrow_schema(TRIANGLE), [{"slot": [TaskContext.get().partitionId()], "entries": [r.tobytes()]}])

    def stack(table: pa.Table) -> pa.Table:
        r = _triangle(np.frombuffer(e.as_buffer(), dtype=np.float64).reshape(-1, d) for e in table.column("entries"))
        return pa.table({"slot": table.column("slot").slice(0, 1), "entries": pa.array([r.tobytes()], type=pa.binary())})

    found = combined(rows.select("x").mapInArrow(reduce_rows, TRIANGLE), scratch, "triangles", stack, TRIANGLE)
    r = np.zeros((d, d))
    upper = np.frombuffer(found.column("entries")[0].as_buffer(), dtype=np.float64).reshape(-1, d)
    r[: len(upper)] = upper
    values, axes = directions(r, components)
    if not len(values):
        return empty
    explained = values / float((r * r).sum())
    project = (axes / np.sqrt(values / n)[:, None]).T

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = None
        for block in blocks(batches):
            met = _merge_moments(met, _moments(block @ project))
        if met is not None:
            yield from kernel.batches(kernel.arrow_schema(MOMENTS), [{"slot": [TaskContext.get().partitionId()], "n": [met[0]], "mean": [met[1].tobytes()], "products": [met[2].tobytes()]}])

    def merge(table: pa.Table) -> pa.Table:
        met = None
        for row in range(table.num_rows):
            met = _merge_moments(met, _unpacked(table, row))
        return pa.table({"slot": table.column("slot").slice(0, 1), "n": pa.array([met[0]], type=pa.int64()), "mean": pa.array([met[1].tobytes()], type=pa.binary()), "products": pa.array([met[2].tobytes()], type=pa.binary())})

    last = _unpacked(combined(rows.select("x").mapInArrow(moments, MOMENTS), scratch, "moments", merge, MOMENTS), 0)
    error = float(np.abs(last[2] / n - np.eye(len(values))).max())

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, k = kernel.arrow_schema(WHITENED), len(values)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                centred, (whole, within) = _exact(_matrix(own), n, middle, rest)
                m = own.num_rows
                yield from kernel.batches(schema, [{
                    "vec_id": own.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), "component": np.tile(np.arange(1, k + 1), m), "n": np.full(m * k, n),
                    "deviation": pa.array(np.repeat(whole, k), mask=np.repeat(~within, k)), "whitened": (centred @ project).ravel(), "explained": np.tile(explained, m),
                }])

    return rows.mapInArrow(results, WHITENED).withColumn("identity_error", F.lit(error))


def _moments(block: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean, and the products of what is centred."""
    mean = block.mean(axis=0)
    return len(block), mean, (block - mean).T @ (block - mean)


def _merge_moments(x: tuple | None, y: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    if x is None:
        return y
    n, apart = x[0] + y[0], y[1] - x[1]
    return n, x[1] + apart * (y[0] / n), x[2] + y[2] + np.outer(apart, apart) * (x[0] * y[0] / n)


def _unpacked(table: pa.Table, row: int) -> tuple[int, np.ndarray, np.ndarray]:
    mean, products = (np.frombuffer(table.column(c)[row].as_buffer(), dtype=np.float64) for c in ("mean", "products"))
    return table.column("n")[row].as_py(), mean, products.reshape(len(mean), len(mean))
