"""Embedding whitening: projections on the leading components of the covariance, each scaled to unit variance.

Three aggregations over all vectors give what the fit needs: their number and sums; their covariance, from integers centred on
the rounded mean, so sums are exact and the same in any order; and, once the components are known, the covariance of the
whitened values. A task adds up its own vectors and hands on one small matrix; rows of these matrices are added per row number.
Only matrices of the vectors' dimension reach the driver, where the components are found (``qdwh``), and go back to the tasks as
a broadcast of dimension x components numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairscope.llm.common import workers_import
from pairscope.llm.qdwh import leading_components

COMPONENTS = 32
#: Entries become whole numbers: floor(STEPS * c) + ORIGIN.
STEPS, ORIGIN = 64, 1_000_000
#: Whole numbers of an entry stay below this, or the job ends with an error.
_LARGEST = 1 << 40
_EXACT = 1 << 53
_SUM = pa.decimal128(38, 0)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def whole_numbers(vectors: pa.Array, d: int) -> np.ndarray:
    """Entries as whole numbers, without ORIGIN: one row per vector."""
    x = np.floor(STEPS * np.asarray(vectors.flatten(), dtype=np.float64)).reshape(-1, d)
    if x.size and np.abs(x).max() >= _LARGEST:
        raise ValueError("an entry of a vector is out of the range that whole numbers are exact in")
    return x.astype(np.int64)


def _gram(y: np.ndarray) -> np.ndarray:
    """y'y, exact, as Python integers."""
    most = int(np.abs(y).max()) if y.size else 0
    if most * most * max(1, len(y)) < _EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    whole = y.astype(object)
    return whole.T @ whole


def _rows_of_sums(vectors: DataFrame, part: Callable[[pa.Array], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of a task-wise matrix over all vectors, in Python integers. Rows of one number meet in one task."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=object)
        for batch in batches:
            if batch.num_rows:
                total = total + part(batch.column(0))
        rows = [pa.array([Decimal(int(v)) for v in row], _SUM) for row in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(_SUM))], names=["i", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = np.array([int(v) for v in sums], dtype=object)
                totals[i] = totals[i] + row if i in totals else row
        rows = [pa.array([Decimal(v) for v in row], _SUM) for row in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(rows, pa.list_(_SUM))], names=["i", "sums"])

    schema = "i int, sums array<decimal(38,0)>"
    found = vectors.mapInArrow(partial, schema).repartition(min(shape[0], 64), "i").mapInArrow(added, schema)
    out = np.zeros(shape, dtype=object)
    for row in found.collect():  # shape[0] rows, whatever the number of vectors
        out[row["i"]] = [int(v) for v in row["sums"]]
    return out


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> dict:
    """n, sums (of the whole numbers without ORIGIN), trace, values and vectors of the leading components.

    ``vectors`` has one column of usable vectors of dimension ``d``. Directions without variance are no components.
    """
    counted = _rows_of_sums(vectors, lambda v: np.array([[len(v), *whole_numbers(v, d).sum(axis=0).tolist()]], dtype=object), (1, d + 1))[0]
    n, sums = counted[0], counted[1:]
    centre = np.array([round(Fraction(s, n)) for s in sums], dtype=np.int64)
    gram = _rows_of_sums(vectors, lambda v: _gram(whole_numbers(v, d) - centre), (d, d))
    # what the rounded mean leaves: y - rest / n is centred
    rest = sums - n * centre.astype(object)
    covariance = np.array([[float(Fraction(n * gram[i, j] - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])
    values, basis = leading_components(covariance, min(components, d))
    real = values > 4 * d * np.finfo(np.float64).eps * max(values.max(), 0)
    return {"n": n, "sums": sums, "centre": centre, "rest": rest, "trace": float(np.trace(covariance)),
            "values": values[real], "basis": basis[:, real]}


def _whitener(model: dict) -> Callable[[np.ndarray], np.ndarray]:
    left = np.array([float(Fraction(r, model["n"])) for r in model["rest"]])
    scaled = model["basis"] / np.sqrt(model["values"])
    return lambda whole: (whole - model["centre"] - left) @ scaled


def _deviation(whole: np.ndarray, model: dict) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2; null if it does not fit a long."""
    most = model["n"] * int(np.abs(whole - model["centre"]).max(initial=0)) + int(max(abs(r) for r in model["rest"]))
    if most * most * whole.shape[1] < 1 << 62:
        away = model["n"] * (whole - model["centre"]) - model["rest"].astype(np.int64)
        return (away * away).sum(axis=1).tolist()
    away = model["n"] * (whole - model["centre"]).astype(object) - model["rest"]
    return [v if v < 1 << 63 else None for v in (away * away).sum(axis=1)]


def identity_error(vectors: DataFrame, d: int, model: dict) -> float:
    """Largest absolute entry of the covariance of all whitened vectors, as the tasks compute them, minus the identity."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    k = len(model["values"])
    unit = 1 << 40

    def part(v: pa.Array) -> np.ndarray:
        white = _whitener(shared.value)(whole_numbers(v, d))
        # sums of a batch as multiples of 2^-40, so that adding them up does not depend on the order
        both = np.rint(np.vstack([white.sum(axis=0), white.T @ white]) * unit)
        return np.array([[int(x) for x in row] for row in both.tolist()], dtype=object)

    totals = _rows_of_sums(vectors, part, (k + 1, k))
    n = model["n"]
    mean = np.array([float(Fraction(t, n * unit)) for t in totals[0]])
    covariance = np.array([[float(Fraction(t, n * unit)) for t in row] for row in totals[1:]]) - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: <id_col>, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds a null or non-finite entry are dropped. The dimension is that of most vectors
    (ties: the larger); vectors of another dimension are dropped like unusable ones. Null identifiers and repeated rows keep
    their rows, and repeats count in the fit. Without vectors, or where all vectors are equal, there are no components and no rows.
    """
    spark = table.sparkSession
    workers_import(spark)
    thin = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    id_type = thin.schema["id"].dataType.simpleString()
    sizes = thin.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "id {}, component int, deviation bigint, whitened double"
    names = ["n", "deviation", "whitened", "explained", "identity_error"]

    def shaped(rows: DataFrame, n: int, explained: list[float], error: float) -> DataFrame:
        parts = F.array(*[F.lit(float(e)) for e in explained]) if explained else F.array(F.lit(None).cast("double"))
        return rows.select("id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                           F.get(parts, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error")
                           ).select(F.col("id").alias(id_col), "component", *names)

    if sizes is None:
        return shaped(spark.createDataFrame([], schema.format(id_type)), 0, [], 0.0)
    d = sizes["d"]
    thin = thin.where(F.size("v") == d)
    vectors = thin.select("v")
    model = fit(vectors, d, components)
    k = len(model["values"])
    if not k:
        return shaped(spark.createDataFrame([], schema.format(id_type)), 0, [], 0.0)
    error = identity_error(vectors, d, model)
    shared = spark.sparkContext.broadcast(model)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = _whitener(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = whole_numbers(batch.column(1), d)
            of = np.repeat(np.arange(len(whole)), k)
            deviation = pa.array(_deviation(whole, shared.value), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(whole))),
                 deviation.take(pa.array(of)), pa.array(white(whole).reshape(-1))],
                names=["id", "component", "deviation", "whitened"])

    rows = thin.mapInArrow(projected, schema.format(id_type))
    return shaped(rows, model["n"], [v / model["trace"] for v in model["values"]], error)
