"""Embedding whitening: covariance from generated sums of centred products, decomposed by LAPACK.

Every entry c of a vector, as double, becomes the integer x = floor(FACTOR * c) + OFFSET;
all sums are sums of integers and therefore exact. The fit list holds each distinct x
vector once, as a table. One aggregation over it gives count, sums and extremes of every
dimension, and one more a generated expression for each pair of dimensions of
the upper triangle: the sum of (x_i - m_i) * (x_j - m_j), with m the dimension's mean
rounded to an integer. What the rounding leaves is taken off in exact integers, so each
entry of the covariance is rounded once. Its eigenvectors come from LAPACK on
the driver, which holds a square of the dimensions and nothing that grows with the rows. The
covariance of the whitened fit list, from the same generated expressions, is the measure of
how well it worked.

Cases: a row whose vector is null or holds a null or non-finite entry takes no part; a
shorter vector counts as continued by zero entries; an entry whose integer has more than 62
bits is an error; repeated rows and ids are rows of their own, and count once in the
fit; an empty table, or one of empty vectors only, gives no rows; fewer dimensions than
components give as many components as dimensions; a component without variance
(its eigenvalue is at most dimensions * 2**-52 of the largest, or zero) has a null whitened value and is left
out of identity_error, which is null if none is left. Further columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm._spark import Scratch, arrow_rows

FACTOR, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Pairs of dimensions summed by one aggregation; more dimensions than about 90 take several over the stored fit list.
PAIRS_AT_ONCE = 4096
#: Vectors that go to Python at once.
VECTOR_ROWS = 4096
DEVIATION = pa.decimal128(38, 0)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = FACTOR, offset: int = OFFSET) -> DataFrame:
    """(id, x) of the rows that take part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(
        F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    whole = lambda c: F.when(F.abs(c * factor) < float(1 << 62), F.floor(c * factor).cast("long")).otherwise(F.raise_error(F.lit("an entry's integer has more than 62 bits")).cast("long"))
    return rows.select("id", F.transform("x", lambda c: whole(c) + offset).alias("x"))


def padded(rows: DataFrame, width: int, offset: int = OFFSET) -> DataFrame:
    """rows with each x continued by zero entries to the width."""
    return rows.withColumn("x", F.when(F.size("x") == width, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(width) - F.size("x")))))


def triangle(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i, width)]


def product_sums(rows: DataFrame, values: list[str], pairs: list[tuple[int, int]]) -> list:
    """The sum over the rows of values[i] * values[j], SQL expressions, for each pair (i, j), in one aggregation a PAIRS_AT_ONCE of pairs."""
    out = []
    named = rows.selectExpr(*[f"{v} AS y{i}" for i, v in enumerate(values)])
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        sums = ", ".join(f"sum(y{i} * y{j})" for i, j in pairs[at : at + PAIRS_AT_ONCE])
        out.extend(named.selectExpr(f"array({sums}) AS sums").head()["sums"])
    return out


@dataclass
class Whitening:
    """n fit vectors, their exact sums, the covariance, eigenvalues falling, and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    error: float | None = None

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def held(self) -> np.ndarray:
        """Which components have variance."""
        return (self.values > 0) & (self.values > self.width * 2.0**-52 * self.values[:1])

    def explained(self) -> list[float | None]:
        trace = float(np.trace(self.covariance))
        return [float(e) / trace if trace > 0 else None for e in self.values]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of rows of integers; NaN for components without variance."""
        shift = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s, self.n) - s // self.n) for s in self.sums])
        scale = np.sqrt(np.where(self.held, self.values, np.nan))
        return ((x - shift).astype(np.float64) - rest) @ self.vectors / scale

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - sum)**2, exact, as decimals of 38 digits."""
        most = max(max(abs(self.n * a - s), abs(self.n * b - s)) for a, b, s in zip(self.low, self.high, self.sums))
        if most * most * self.width < 1 << 63 and self.n * max(map(abs, self.low + self.high)) < 1 << 63:
            z = self.n * x - np.array(self.sums, np.int64)
            return pa.array((z * z).sum(1)).cast(DEVIATION)
        z = self.n * x.astype(object) - np.array(self.sums, object)
        return pa.array([Decimal(v) for v in (z * z).sum(1).tolist()], DEVIATION)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct x of rows(x), all of one width; None without rows or dimensions."""
    with Scratch() as s:
        fitted = s.cut(rows.select("x").distinct(), "fit-list")
        width = (fitted.limit(1).select(F.size("x")).head() or [0])[0]
        if not width:
            return None
        each = ", ".join(f"cast(sum(cast(x[{i}] AS decimal(38, 0))) AS decimal(38, 0)), cast(min(x[{i}]) AS decimal(38, 0)), cast(max(x[{i}]) AS decimal(38, 0))" for i in range(width))
        got = fitted.selectExpr("count(1) AS n", f"array({each}) AS of").head()
        n, (sums, low, high) = got["n"], ([int(v) for v in got["of"][k::3]] for k in range(3))
        mean = [(2 * t + n) // (2 * n) for t in sums]
        apart = max(max(b - m, m - a) for a, b, m in zip(low, high, mean))
        # Sums that 64 bits surely hold are taken as such; others as decimals, which fail where they do not fit.
        kind = "long" if apart * apart * n < 1 << 63 else "decimal(19, 0)"
        centred = [f"cast(x[{i}] - {m}L AS {kind})" for i, m in enumerate(mean)]
        pairs = triangle(width)
        products = product_sums(fitted, centred, pairs)
        left = [t - n * m for t, m in zip(sums, mean)]
        covariance = np.zeros((width, width))
        for (i, j), p in zip(pairs, products):
            covariance[i, j] = covariance[j, i] = float(Fraction(n * int(p) - left[i] * left[j], n * n))
        values, vectors = np.linalg.eigh(covariance)
        keep = np.arange(width)[::-1][:components]
        model = Whitening(n, sums, low, high, covariance, values[keep], vectors[:, keep])
        model.error = identity_error(fitted, model)
        return model


def identity_error(fitted: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    at = np.flatnonzero(model.held)
    if not len(at):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            white = model.project(_matrix(batch.column(0), model.width))[:, at]
            yield pa.RecordBatch.from_arrays([pa.array(white[:, k]) for k in range(len(at))], [f"w{k}" for k in range(len(at))])

    with arrow_rows(fitted.sparkSession, VECTOR_ROWS):
        white = fitted.select("x").mapInArrow(run, ", ".join(f"w{k} double" for k in range(len(at))))
        # The last column of ones gives the sums: what is left of the means, far below rounding of the products.
        values, pairs = [*[f"w{k}" for k in range(len(at))], "1d"], triangle(len(at) + 1)
        sums = dict(zip(pairs, product_sums(white, values, pairs)))
    n, last = model.n, len(at)
    return max(abs(sums[i, j] / n - sums[i, last] / n * (sums[j, last] / n) - (i == j)) for i, j in triangle(len(at)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>) of rows(id, x); a component without variance is a null entry."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, deviation decimal(38,0), whitened array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), model.width)
            white = model.project(x)
            flat = pa.array(white.ravel(), mask=np.isnan(white).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), model.deviations(x), lists], ["id", "deviation", "whitened"])

    if model is None:
        return rows.select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).where(F.lit(False))
    with arrow_rows(rows.sparkSession, VECTOR_ROWS):
        return rows.select("id", "x").mapInArrow(run, schema)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = FACTOR, offset: int = OFFSET, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = integers(vectors, id_col, vector_col, factor, offset)
    width = rows.agg(F.max(F.size("x"))).head()[0] or 0
    rows = padded(rows, width, offset)
    model = fit(rows, components)
    flat = whiten(rows, model).select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    numbers = lambda xs: F.array(*[F.lit(x).cast("double") for x in xs])
    return flat.select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        (numbers(model.explained()) if model else F.array(F.lit(None).cast("double")))[F.col("at")].alias("explained"),
        F.lit(model.error if model else None).cast("double").alias("identity_error"),
    )
