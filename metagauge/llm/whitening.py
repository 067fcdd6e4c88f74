"""Whitening of vectors, fitted on every distinct vector with a weight.

Equal vectors are grouped first, and the group is what is fitted, whitened and stored; rows get their group's answer by a join.
Vectors are whole numbers, so means and deviations from them are exact; covariances are sums of products of centred vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metagauge.llm.tables import stored, whole_row
from metagauge.llm.vectors import matrix, rows_of, widest

_LONG = 2**63 - 1
#: Rows of a batch that are multiplied at once.
STEP_ROWS = 4096


@dataclass(frozen=True)
class Centre:
    """What the deviations are taken from: the sum of weights, and the weighted sum of each dimension."""

    n: int
    sums: tuple[int, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly; in Python's numbers where 64 bits might not do."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if most * self.n + max(map(abs, self.sums), default=0) > _LONG:
            x = x.astype(object)
        return x * self.n - np.array(self.sums, dtype=x.dtype)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    """Components in the columns of ``basis``, each over its standard deviation; ``explained`` is its share of all variance."""

    centre: Centre
    basis: np.ndarray
    explained: np.ndarray


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(at, STEP_ROWS)


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("weight").to_numpy(zero_copy_only=False)


def _centre(distinct: DataFrame, width: int) -> Centre:
    """Sums are taken as decimals, so that none can overflow."""
    at = F.posexplode(F.col("x")).alias("at", "entry")
    product = F.col("entry").cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")
    found = distinct.select(at, "weight").groupBy("at").agg(F.sum(product.cast("decimal(38,0)")).alias("s")).collect()
    sums = [0] * width
    for row in found:
        sums[row["at"]] = int(row.s)
    return Centre(int(distinct.agg(F.sum("weight")).first()[0] or 0), tuple(sums))


def _products(distinct: DataFrame, column: str, width: int, centre: Centre | None) -> np.ndarray:
    """The weighted sum of the outer products of all (centred) vectors: one matrix a task, added entry by entry."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in _steps(batches):
            x = matrix(batch.column(column), width)
            c = centre.centred(x) if centre else x
            total += (c * _weights(batch)[:, None]).T @ c
        line = pa.array(np.arange(width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([line, rows_of(total)], ["line", "entries"])

    parts = distinct.select(column, "weight").mapInArrow(added, "line int, entries array<double>")
    entries = parts.select("line", F.posexplode("entries").alias("at", "entry"))
    out = np.zeros((width, width))
    for row in entries.groupBy("line", "at").agg(F.sum("entry").alias("entry")).collect():
        out[row.line, row["at"]] = row.entry
    return out


def fit(distinct: DataFrame, components: int) -> Whitening:
    """From ``x`` and ``weight`` of every distinct vector. A dimension's square of numbers comes to the driver, no vectors."""
    width = widest(distinct, "x")
    centre = _centre(distinct, width)
    if not centre.n or not width:
        return Whitening(centre, np.zeros((width, 0)), np.zeros(0))
    covariance = _products(distinct, "x", width, centre) / centre.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    real = values > max(trace, 0.0) * width * np.finfo(np.float64).eps
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
    return Whitening(centre, vectors * scale, np.where(real, values, 0.0) / (trace or 1.0))


def _whitened(distinct: DataFrame, model: Whitening) -> DataFrame:
    width = len(model.centre.sums)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            away = model.centre.deviations(matrix(batch.column("x"), width))
            most = max(abs(int(away.max(initial=0))), abs(int(away.min(initial=0))))
            wide = away if most * most * max(1, width) <= _LONG else away.astype(object)
            squares = (wide * wide).sum(axis=1).tolist()
            whitened = (away / model.centre.n).astype(np.float64) @ model.basis
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("x"),
                    batch.column("weight"),
                    pa.array([s if s <= _LONG else None for s in squares], pa.int64()),
                    rows_of(whitened),
                ],
                ["x", "weight", "deviation", "whitened"],
            )

    kinds = "x array<bigint>, weight long, deviation long, whitened array<double>"
    return distinct.select("x", "weight").mapInArrow(mapped, kinds)


def whiten(vectors: DataFrame, components: int = 16, weight: str = "one") -> DataFrame:
    """``vectors`` with its columns and, for each of the first ``components`` principal components, a row with ``component``
    (from 1, by falling variance), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    The column ``x`` holds vectors of whole numbers; rows whose ``x`` is null are left out, and a shorter vector counts as one
    with zeros at its end. The fit takes each distinct vector with the weight ``"one"``, or with the ``"count"`` of its rows;
    n is the sum of weights. A component without variance (vectors that are all equal, or fewer of them than dimensions) has
    whitened values and a share of 0, and the identity is not asked of it; no rows and vectors without entries give none.
    A deviation beyond 64 bits is null.

    A vector that many rows hold is one group after a partial aggregate; in the last join its rows can be split, since both
    sides come from an exchange of their own. The driver gets sums and the covariance, d * d numbers.
    """
    if weight not in ("one", "count"):
        raise ValueError(f"no such weight: {weight}")
    rows = vectors.withColumn("x", F.col("x").cast("array<bigint>")).where("x is not null")
    grouped = rows.select("x").groupBy("x").agg(F.count(F.lit(1)).alias("weight"))
    if weight == "one":
        grouped = grouped.withColumn("weight", F.lit(1).cast("long"))
    distinct = stored(grouped)
    model = fit(distinct, components)
    done = stored(_whitened(distinct, model))
    k = model.basis.shape[1]
    error = 0.0
    if k:
        covariance = _products(done, "whitened", k, None) / model.centre.n
        real = model.explained > 0
        error = float(np.abs(covariance - np.eye(k))[np.ix_(real, real)].max(initial=0.0))
    shares = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    given = [c for c in rows.columns if c.lower() != "x"]
    answers = done.select(F.col("x").alias("x"), F.struct("deviation", "whitened").alias("answer"))
    joined = rows.select("x", whole_row(rows, "x").alias("row")).join(answers, "x")
    placed = joined.select("row", "answer.deviation", F.posexplode("answer.whitened").alias("at", "whitened"))
    return placed.select(
        *[F.col(f"row.`{c}`") for c in given],
        (F.col("at") + 1).alias("component"),
        F.lit(model.centre.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
