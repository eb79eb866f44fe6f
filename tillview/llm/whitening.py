"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers, floor(``SCALE`` * entry). The rows fitted are the different integer vectors,
each once, so copies of a vector weigh no more than one. With A the centred rows fitted, steps
alternate products of A with a right vector and of its transpose with a left one, each orthogonalised
against all before it, until A V = U B with B bidiagonal. The singular values and right vectors of the
small B, carried over by V, are the deviations and components.

Both products are taken in one pass over the rows per step. A left vector is as long as the table, so
it is never written: it is A p for a short vector p, which the driver keeps, and tasks work it out
anew from their rows. What a pass returns are sums of as many numbers as a vector has entries and
there were steps, added up by Spark by position. Right vectors, p and B stay on the driver; their
number is that of steps, at most the length of a vector.

Steps end when the wanted components have converged to double precision and what B has not yet
explained of the total variance is less than the least of them, so that no component of equal
variance is missed; or when they span all. Where a step ends in nothing before that, a new start
orthogonal to all right vectors goes on.

Edge cases: rows whose vector is null, empty, holds null or non-finite entries, or has another length
than most (of equally frequent lengths the longest) are left out; rows keep their ids, null, repeated
or not. Components without variance (fewer different rows than components, say) have no whitened
value, explain 0 and do not count for the error of identity, which is null if none is left. A
deviation beyond a long is null. Without usable rows there is no result row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.sources.staging import stage

SCALE = 256
COMPONENTS = 4
#: Relative to the largest: residuals taken as none, and variances taken as none.
CONVERGED = 1e-14
NOTHING = 1e-11
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """Rows fitted, sums by dimension, unit components as rows, their deviations and total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    variance: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def rotate(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of integer rows, of components that have variance."""
        return (x - self.centre) @ self.components.T / self.deviations


def integers(rows: DataFrame, vector: str) -> DataFrame:
    """Usable rows with the vector of integers as ``x`` beside their other columns."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    some = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    return some.withColumn("x", F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(fit: DataFrame, numbers: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of what ``numbers`` says of a block of them: a list of doubles of fixed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                own = numbers(_matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["numbers"])

    parts = fit.select("x").mapInArrow(run, "numbers array<double>").select(F.posexplode("numbers").alias("place", "number"))
    table = parts.groupBy("place").agg(F.sum("number").alias("number")).toArrow()
    out = np.zeros(len(table))
    out[table["place"].to_numpy()] = table["number"].to_numpy()
    return out


def _counted(fit: DataFrame) -> tuple[int, list[int], list[int]]:
    """Rows, and exact sums and sums of squares by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums, squares = 0, 0, 0
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0))
                if float(np.abs(x.astype(float)).max()) ** 2 * len(x) >= LONGEST:
                    x = x.astype(object)
                rows += len(x)
                sums = sums + x.sum(axis=0).astype(object)
                squares = squares + (x * x).sum(axis=0).astype(object)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(sums)), pa.int64()),
                    pa.array([rows] * len(sums), pa.int64()),
                    pa.array(map(str, sums), pa.string()),
                    pa.array(map(str, squares), pa.string()),
                ],
                ["place", "rows", "sum", "square"],
            )

    parts = fit.select("x").mapInArrow(run, "place long, rows long, sum string, square string")
    exact = {c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c) for c in ("sum", "square")}
    by_place = parts.groupBy("place").agg(F.sum("rows").alias("rows"), *exact.values()).orderBy("place").collect()
    return by_place[0].rows, [int(r["sum"]) for r in by_place], [int(r["square"]) for r in by_place]


def bidiagonalise(
    product: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]],
    size: int,
    energy: float,
    wanted: int,
    seed: int = 1,
) -> tuple[np.ndarray, np.ndarray]:
    """Deviations times the root of the number of rows, falling, and components as rows.

    ``product(q, P)`` gives, for y = A q and U = A P, the sum of squares of y, U'y and A'y. ``energy`` is the sum
    of squares of A.
    """
    rng = np.random.default_rng(seed)
    right, coordinates, images = (np.zeros((size, 0)) for _ in range(3))
    diagonal: list[float] = []
    upper: list[float] = []
    floor = NOTHING * np.sqrt(energy)

    def fresh() -> np.ndarray | None:
        if right.shape[1] == size:
            return None
        return _apart(rng.standard_normal(size), right)

    v, beta = fresh(), 0.0
    while v is not None:
        q = v - (beta * coordinates[:, -1] if beta else 0.0)
        square, with_left, image = product(q, coordinates)
        q, image = q - coordinates @ with_left, image - images @ with_left
        alpha = float(np.sqrt(max(square - with_left @ with_left, 0.0)))
        right = np.column_stack([right, v])
        if alpha <= floor:  # v adds nothing that earlier left vectors do not hold
            coordinates, images = (np.column_stack([m, np.zeros(size)]) for m in (coordinates, images))
            alpha, rest = 0.0, np.zeros(size)
        else:
            coordinates = np.column_stack([coordinates, q / alpha])
            images = np.column_stack([images, image / alpha])
            rest = images[:, -1] - alpha * v
        diagonal.append(alpha)
        beta = 0.0
        v = None
        if right.shape[1] < size:
            rest = rest - right @ (right.T @ rest)
            rest = rest - right @ (right.T @ rest)
            beta = float(np.linalg.norm(rest))
            if beta > floor:
                v = rest / beta
            else:
                beta, v = 0.0, fresh()
        upper.append(beta)
        left, values, turned = np.linalg.svd(np.diag(diagonal) + np.diag(upper[:-1], 1))
        if len(values) >= wanted and beta:
            open_ends = beta * np.abs(left[-1, :wanted])
            hidden = energy - (values**2).sum() - beta**2
            if (open_ends <= CONVERGED * values[0]).all() and hidden < values[wanted - 1] ** 2:
                break
    keep = values[:wanted] > floor
    return values[:wanted][keep], (turned[:wanted][keep] @ right.T)


def _apart(v: np.ndarray, right: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - right @ (right.T @ v)
    return v / np.linalg.norm(v)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of the rows ``x`` of ``fit``, which should be a table, as each step reads it once."""
    n, sums, squares = _counted(fit)
    size = len(sums)
    centre = np.array([float(Fraction(s, n)) for s in sums])
    energy = float(sum(Fraction(n * q - s * s, n) for s, q in zip(sums, squares, strict=True)))
    wanted = min(components, size)
    if not energy:
        return Whitening(n, sums, np.zeros((0, size)), np.zeros(0), 0.0)

    def product(q: np.ndarray, before: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def numbers(x: np.ndarray) -> np.ndarray:
            rows = x - centre
            y = rows @ q
            return np.concatenate([[y @ y], (rows @ before).T @ y, y @ rows])

        found = _summed(fit, numbers)
        return float(found[0]), found[1 : 1 + before.shape[1]], found[1 + before.shape[1] :]

    values, axes = bidiagonalise(product, size, energy, wanted)
    # either sign is a component: the largest entry is positive
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Whitening(n, sums, axes, values / np.sqrt(n), energy / n)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest entry, sign aside, of the whitened rows' covariance less the identity."""
    k = len(model.deviations)
    if not k:
        return None

    def numbers(x: np.ndarray) -> np.ndarray:
        w = model.rotate(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = _summed(fit, numbers) / model.n
    mean = found[:k]
    return float(np.abs(found[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2 of each row, exact."""
    most = n * int(np.abs(x.astype(object)).max()) + max(map(abs, sums))
    if most * most * len(sums) <= LONGEST:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v <= LONGEST else None for v in exact]


def whiten(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained and identity_error, a row per row and component."""
    usable = integers(rows.select(F.col(key).alias("id"), F.col(vector).alias("v")), "v").select("id", "x")
    usable = stage(usable, "whitening-rows")
    schema = rows.select(key).schema
    lengths = usable.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double")):
        schema = schema.add(name, kind)
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema.add("explained", "double").add("identity_error", "double"))
    size = lengths["size"]
    usable = usable.where(F.size("x") == size)
    fit = stage(usable.select("x").distinct(), "whitening-fit")
    model = fit_whitening(fit, components)
    error = identity_error(fit, model)
    count = min(components, size)
    shares = [float(d * d / model.variance) for d in model.deviations] + [0.0] * (count - len(model.deviations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            whitened = model.rotate(x)
            each = np.repeat(np.arange(len(x)), count)
            values = np.full((len(x), count), np.nan)
            values[:, : whitened.shape[1]] = whitened
            flat = values.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.n)),
                    pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)),
                    pa.array(flat, mask=np.isnan(flat)),
                ],
                schema.names,
            )

    out = usable.mapInArrow(run, schema)
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("component"))
    return out.withColumns({"explained": explained, "identity_error": F.lit(error).cast("double")})
