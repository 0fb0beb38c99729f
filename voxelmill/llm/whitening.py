"""Whitening of embeddings by Chebyshev-filtered subspace iteration over distributed passes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from math import isqrt

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.common import materialise

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Vectors of the block beyond the wanted ones, at least; they set the edge of the damped spectrum.
GUARD = 16
#: Least and greatest degree of a filter, steps of the bounds' Lanczos run, and most filters.
DEGREES, STEPS, MOST = (4, 24), 10, 60
#: A filter may raise the greatest direction over the last wanted one by this factor: what rounding leaves is still told apart.
SPREAD = 1e8
#: A pair is certified when its residual is at most this part of the greatest eigenvalue.
TOLERANCE = 1e-13
#: Partial sums that the driver adds itself; more are added on the executors first.
FAN = 256
#: Eigenvalues up to this part of the greatest (times the dimensions) are rounding: a component without variance.
RANK = 1e-15


@dataclass
class Model:
    """What a whitening needs: number of rows, exact sums, components in columns, their eigenvalues, the trace, the largest identity error."""

    n: int
    sums: list[int]
    basis: object
    values: object
    trace: float
    identity_error: float = 0.0


def _matrix(column):
    """An Arrow column of equally long lists of numbers as a matrix."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector is there and has only finite entries; ``x`` holds the long entries."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            for i in range(0, len(lists), 4096):
                part = lists.slice(i, 4096).drop_null()
                ids = batch.column(0).slice(i, 4096).filter(lists.slice(i, 4096).is_valid())
                flat = part.flatten()
                good = np.isfinite(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
                sizes = part.value_lengths().to_numpy(zero_copy_only=False)
                bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~good], minlength=len(sizes)) > 0
                keep = ~bad
                x = np.floor(SCALE * flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)[np.repeat(keep, sizes)])
                if len(x) and np.abs(x).max() >= 2.0**62:
                    raise OverflowError("an embedding's entry does not fit a long")
                at = np.cumsum([0, *sizes[keep]], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int64) + SHIFT))], names=["vec_id", "x"])

    kind = vectors.schema[id_column].dataType.simpleString()
    return vectors.select(id_column, vector_column).mapInArrow(run, f"vec_id {kind}, x array<long>")


def _summed(rows: DataFrame, tasks: int, part_sum) -> list:
    """The sum of ``part_sum(matrix)``, a tuple of arrays of doubles, over all batches of ``rows(x)``, read by ``tasks`` tasks.

    Each task adds its batches and gives one row.  Beyond FAN tasks their rows
    are added in about sqrt(tasks) groups on the executors; the driver adds at
    most that many arrays, of d times the block's width entries.
    """
    import pickle

    import numpy as np

    def task(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                got = part_sum(_matrix(batch.column(0)))
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(total)], pa.binary())], names=["task", "part"])

    def group(key, table):
        import pyarrow as pa

        parts = [pickle.loads(p) for _, p in sorted(zip(table["task"].to_pylist(), table["part"].to_pylist(), strict=True))]
        return pa.table({"task": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([pickle.dumps([sum(p) for p in zip(*parts, strict=True)])], pa.binary())})

    parts = rows.select("x").mapInArrow(task, "task int, part binary")
    if tasks > FAN:
        parts = parts.groupBy(F.pmod("task", F.lit(isqrt(tasks))).alias("slot")).applyInArrow(group, "task int, part binary")
    found = [pickle.loads(p) for _, p in sorted(map(tuple, parts.collect()))]
    return [np.sum(p, axis=0) for p in zip(*found, strict=True)]


def _counted(summed) -> list[int]:
    """Exact sums of each entry, which are added in two halves of 32 bits."""

    def part(x):
        return [(x >> 32).sum(0).astype(object), (x & 0xFFFFFFFF).sum(0).astype(object)]

    return [(int(h) << 32) + int(v) for h, v in zip(*summed(part), strict=True)]


def _offsets(x, n: int, sums):
    """The longs ``n x - S``; whatever wraps on the way comes back where the result fits."""
    import numpy as np

    return n * x - np.array([(s + 2**63) % 2**64 - 2**63 for s in sums], np.int64)


def _squares(x, n: int, sums) -> list:
    """Sums of squared deviations by entry, times n squared."""
    import numpy as np

    if len(x) and np.abs(float(n) * x - np.array([float(s) for s in sums])).max() >= 2.0**62:
        raise OverflowError("a deviation does not fit a long")
    return [(_offsets(x, n, sums).astype(float) ** 2).sum(0)]


def _edges(apply, start) -> tuple[float, float]:
    """Bounds of the spectrum from a short Lanczos run: extreme Ritz values and the last residual."""
    import numpy as np

    vectors, a, b = [start / np.linalg.norm(start)], [], []
    for _ in range(min(STEPS, len(start))):
        w = apply(vectors[-1][:, None])[:, 0]
        a.append(w @ vectors[-1])
        for _ in range(2):
            for v in vectors:
                w = w - (w @ v) * v
        b.append(np.linalg.norm(w))
        if b[-1] <= 1e-12 * max(map(abs, a)):
            b[-1] = 0.0
            break
        vectors.append(w / b[-1])
    ritz = np.linalg.eigvalsh(np.diag(a) + np.diag(b[:-1], 1) + np.diag(b[:-1], -1))
    return max(0.0, ritz[0] - b[-1]), ritz[-1] + b[-1]


def _rayleigh_ritz(block, image):
    """Ritz vectors, values and images of an orthonormal block, by falling value."""
    import numpy as np

    small = block.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return block @ turn, values[::-1], image @ turn


def eigenpairs(apply, size: int, wanted: int, trace: float):
    """The ``wanted`` greatest eigenpairs ``(values, vectors)`` of the symmetric non-negative operator ``apply`` (matrix to image).

    A block of wanted + GUARD vectors is filtered by a Chebyshev polynomial of
    the operator, which stays within one on the unwanted interval, from the
    spectrum's lower bound to the block's least Ritz value, and grows beyond
    it; then QR and Rayleigh-Ritz.  It ends when all wanted residuals are at
    most TOLERANCE times the greatest value, or no longer fall (rounding), and
    the values agree with those of the filter before.  In the place of the
    block's last vector a fresh random one enters each time, so that a missed
    direction has a way in.  A block as wide as the space needs one pass.
    """
    import numpy as np

    rng = np.random.default_rng(11)
    width = min(size, wanted + max(GUARD, wanted // 2))
    block = np.linalg.qr(rng.standard_normal((size, width)))[0]
    low = 0.0 if width == size else _edges(apply, rng.standard_normal(size))[0]
    block, values, image = _rayleigh_ritz(block, apply(block))
    best, still, before = np.inf, 0, None
    for _ in range(MOST):
        scale = max(values[0], trace / size)
        residual = np.linalg.norm(image[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0).max()
        settled = before is not None and np.abs(values[:wanted] - before).max() <= 1e-12 * scale
        still = still + 1 if residual > best / 2 else 0
        best, before = min(best, residual), values[:wanted]
        if width == size or settled and (residual <= TOLERANCE * scale or still > 1 and residual <= 1e-10 * scale):
            return values[:wanted], block[:, :wanted]
        edge = values[-2]  # the last is that of a random vector
        if not low < edge:
            low = 0.0
        centre, half = (edge + low) / 2, max((edge - low) / 2, 1e-300)
        growth = np.arccosh(np.maximum(1.0, (values[[0, wanted - 1]] - centre) / half))
        need = np.log(max(2.0, residual / (TOLERANCE * scale))) / max(growth[1], 1e-3)
        may = np.log(SPREAD) / max(growth[0] - growth[1], 1e-3)
        degree = int(np.clip(min(need + 1, may), *DEGREES))
        # rows of growth differ by many powers of ten: each vector is kept at unit length at the greatest value
        sigma = half / (max(values[0], edge) - centre) if values[0] > centre else 1.0
        first, last, now = sigma, block, (image - centre * block) * (sigma / half)
        for _ in range(degree - 1):
            nxt = 1 / (2 / first - sigma)
            last, now = now, (apply(now) - centre * now) * (2 * nxt / half) - (sigma * nxt) * last
            sigma = nxt
        now[:, -1] = rng.standard_normal(size)
        block = np.linalg.qr(now)[0]
        block = np.linalg.qr(block)[0]
        block, values, image = _rayleigh_ritz(block, apply(block))
    raise ArithmeticError(f"no certified components after {MOST} filters: residual {best}")


def fit(rows: DataFrame, components: int = 32) -> Model | None:
    """A model from written ``rows(vec_id, x)``; None without rows.

    Each application of the covariance is one pass of centred XᵀX Q over the
    rows.  Components without variance (rank lower than ``components``) are
    left out.
    """
    import numpy as np

    n, least, size = rows.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return None
    if least != size:
        raise ValueError(f"embeddings have {least} to {size} entries")
    summed = partial(_summed, rows, rows.rdd.getNumPartitions())
    sums = _counted(summed) if size else []
    trace = float(summed(lambda x: _squares(x, n, sums))[0].sum()) / n**3 if size else 0.0
    if trace == 0.0:
        return Model(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0)

    def apply(block):
        def part(x):
            z = _offsets(x, n, sums) / n
            return [z.T @ (z @ block)]

        return summed(part)[0] / n

    values, basis = eigenpairs(apply, size, min(components, size), trace)
    keep = values > RANK * size * values[0]
    values, basis = values[keep], basis[:, keep]
    largest = np.abs(basis).argmax(0)
    model = Model(n, sums, basis * np.sign(basis[largest, np.arange(len(values))]), values, trace)

    def gram(x):
        w = _whitened(_offsets(x, n, sums), model)
        return [w.T @ w, w.sum(0)]

    second, first = summed(gram)
    model.identity_error = float(np.abs(second / n - np.outer(first, first) / n**2 - np.eye(len(values))).max())
    return model


def _whitened(offsets, model: Model):
    import numpy as np

    return offsets / model.n @ model.basis / np.sqrt(model.values)


def _exact_squares(offsets):
    """Row sums of squares as decimals of 38 digits."""
    from decimal import Decimal

    import pyarrow as pa

    kind = pa.decimal128(38, 0)
    if len(offsets) and (offsets.astype(float) ** 2).sum(1).max() >= 2.0**62:
        return pa.array([Decimal(sum(v * v for v in row)) for row in offsets.tolist()], kind)
    return pa.array((offsets**2).sum(1), pa.int64()).cast(kind)


def whiten(vectors: DataFrame, components: int = 32, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row for each usable vector and component: ``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    Rows whose vector is null or holds a null, NaN or infinite entry are left
    out.  Repeated rows and equal ids all count and all come back; a null id
    stays null; other columns are not read.  Equal eigenvalues get any basis of
    their space, the same for all rows.  Components are the greatest
    ``components`` of positive variance: a single row, equal rows or an empty
    table give no rows.  ``deviation`` is exact, a decimal of 38 digits.
    Vectors of different lengths raise ValueError; an entry or ``n x - S`` that
    does not fit a long raises OverflowError.
    """
    rows = materialise(usable(vectors, id_column, vector_column))
    model = fit(rows, components)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                off, k = _offsets(_matrix(part.column(1)), model.n, model.sums), len(model.values)
                m = len(off)
                cols = [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    _exact_squares(off).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(_whitened(off, model).ravel()),
                    pa.array(np.tile(model.values / model.trace, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(run, schema)
