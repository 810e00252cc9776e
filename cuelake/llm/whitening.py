"""Whitened embeddings from exact integer moments, counted on bit planes."""
from __future__ import annotations

import math
from collections import defaultdict
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import staged

#: Rows whose planes are packed together, and components returned at most.
ROWS, COMPONENTS = 8_192, 16
#: An eigenvalue below this share of the largest one is rounding, not variance.
RANK = 1e-13
#: Largest integer that a component may become, either sign.
TOP = 2**52
DECIMAL = pa.decimal128(38, 0)


def shifted(table: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Adds x, the vector as integers floor(scale * c) + offset; rows whose vector is null,
    empty or holds null or non-finite components are left out."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall("_c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    fits = F.forall("_c", lambda v: F.abs(v) < F.lit(TOP / scale))
    whole = F.transform("_c", lambda v: F.floor(v * scale).cast("bigint") + offset)
    rows = table.withColumn("_c", c).filter("_c IS NOT NULL AND size(_c) > 0").filter(good)
    return rows.withColumn("x", F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for an exact sum")))).drop("_c")


def planes(y: np.ndarray) -> list[np.ndarray]:
    """Bit planes of non-negative integers (rows, dimensions): plane p holds bit p of every
    value, for each dimension as words of 64 rows."""
    rows = -(-len(y) // 64) * 64
    y = np.vstack([y, np.zeros((rows - len(y), y.shape[1]), y.dtype)])
    found = []
    for p in range(int(y.max(initial=0)).bit_length()):
        bits = np.packbits(((y >> p) & 1).astype(np.uint8).T, axis=1)
        found.append(np.ascontiguousarray(bits).view(np.uint64))
    return found


def scatter(y: np.ndarray) -> list[list[int]]:
    """Exact sums of y_i * y_j over the rows: popcounts of ANDed planes, weighted by 2^(p+q)."""
    width, held = y.shape[1], planes(y)
    out = np.zeros((width, width), object)
    for p, left in enumerate(held):
        for q, right in enumerate(held[p:], p):
            both = np.stack([np.bitwise_count(left[i] & right).sum(axis=1, dtype=np.int64) for i in range(width)])
            out += (both if p == q else both + both.T).astype(object) << (p + q)
    return out


def moments(fit: DataFrame, least: dict[int, list[int]]) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """By length of the vectors: (n, sums, exact sums of products), all after taking off the least
    value of each dimension.

    Each task adds up its batches and sends one row a pair of dimensions, so that what is
    shuffled and returned depends on the length of the vectors and the tasks only.
    """

    def rows(batches):
        held = {}
        for batch in batches:
            sizes = np.diff(batch["x"].offsets.to_numpy())
            for width in np.unique(sizes):
                of = batch.filter(pa.array(sizes == width))["x"]
                y = of.flatten().to_numpy().reshape(len(of), width) - np.array(least[int(width)], np.int64)
                for s in range(0, len(y), ROWS):
                    part = y[s : s + ROWS]
                    n, sums, products = held.get(width, (0, 0, 0))
                    held[width] = (n + len(part), sums + part.sum(axis=0).astype(object), products + scatter(part))
        for width, (n, sums, products) in held.items():
            i, j = np.triu_indices(int(width))
            values = [n, *sums, *products[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(width)] * len(values), pa.int32()), pa.array(np.arange(len(values)), pa.int32()), pa.array([v >> 40 for v in map(int, values)], pa.decimal128(38, 0)), pa.array([int(v) & (2**40 - 1) for v in values], pa.int64())],
                names=["width", "at", "high", "low"],
            )

    parts = fit.mapInArrow(rows, "width int, at int, high decimal(38,0), low bigint")
    sums = parts.groupBy("width", "at").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    by = defaultdict(dict)
    for r in sums:
        by[r.width][r.at] = (int(r.high) << 40) + int(r.low)
    out = {}
    for width, v in by.items():
        square = [[0] * width for _ in range(width)]
        for at, (i, j) in enumerate(zip(*np.triu_indices(width)), width + 1):
            square[i][j] = square[j][i] = v[at]
        out[width] = (v[0], [v[1 + d] for d in range(width)], square)
    return out


def components(n: int, sums: list[int], products: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions as columns, their eigenvalues, shares of the trace), by falling eigenvalue.

    The covariance is centred as integers, n * sum(y_i y_j) - sum(y_i) * sum(y_j), and divided by n^2
    once, so that the only rounding before eigh is that of each entry. Of each direction the
    entry of the largest size is positive.
    """
    cov = np.array([[float(Fraction(n * p - a * b, n * n)) for p, b in zip(row, sums)] for row, a in zip(products, sums)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(most, int((values > RANK * max(values[0], 0.0)).sum())) if values[0] > 0 else 0
    values, vectors = values[:keep], vectors[:, :keep]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(keep)]) if keep else np.ones(0)
    trace = math.fsum(np.diag(cov))
    return vectors * sign, values, values / trace if keep else values


def _scores(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S as integers, whitened rows)."""
    most = model["n"] * int(np.abs(x).max(initial=0))
    if most >= 2**62:
        raise ValueError("rows times components exceed 64 bits")
    centred = model["n"] * x - model["sums"]
    return centred, (centred / model["n"]) @ model["axes"] / np.sqrt(model["values"])


def whiten(table: DataFrame, *, scale: int = 64, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of table (vec_id, embedding).

    Vectors become integers x = floor(scale * c) + 1,000,000. The model is fitted on every
    distinct x once: n of them with sums S and an exact covariance of divisor n. Each row gets one
    row a component, `most` at most, numbered from 1 by falling eigenvalue: deviation is the
    sum of (n * x - S)^2 over the dimensions, exact; whitened the centred x projected on the component over
    the root of its eigenvalue; explained the eigenvalue's share of the trace. identity_error, one
    value for all rows, is the largest absolute entry of the whitened covariance over the
    distinct vectors minus the identity.

    Rows whose vector is null, empty or holds null or non-finite components give nothing.
    Repeated rows are returned each; a null vec_id stays null. Directions without variance
    (repeated or constant dimensions, a single distinct vector) have no component. Vectors of
    another length have a model of their own. Other columns are dropped, an empty table
    gives an empty table. deviation is a decimal, as it leaves 64 bits past some 10^8 vectors; values whose
    sums leave 64 bits, or whose squares leave 38 digits, raise an error.
    """
    rows = shifted(table.select("vec_id", "embedding"), scale).select("vec_id", "x")
    fit = staged(rows.select("x").distinct(), "distinct-vectors")
    lows = fit.select(F.size("x").alias("width"), F.posexplode("x").alias("d", "v")).groupBy("width", "d").agg(F.min("v").alias("low")).collect()
    least = defaultdict(dict)
    for r in lows:
        least[r.width][r.d] = r.low
    least = {w: [v[d] for d in range(w)] for w, v in least.items()}
    models = {}
    for width, (n, sums, products) in moments(fit, least).items():
        axes, values, shares = components(n, sums, products, most)
        full = [s + n * low for s, low in zip(sums, least[width])]
        if max(map(abs, full)) >= 2**62:
            raise ValueError("sums of these vectors exceed 64 bits")
        models[width] = {"n": n, "sums": np.array(full, np.int64), "axes": axes, "values": values, "shares": shares, "error": 0.0}

    def squares(batches):
        held = {}
        for batch in batches:
            for width, of in _by_width(batch):
                model = models[width]
                w = _scores(of["x"].flatten().to_numpy().reshape(of.num_rows, width), model)[1]
                held[width] = held.get(width, 0) + w.T @ w
        for width, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([width] * total.size, pa.int32()), pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["width", "at", "v"])

    if any(len(m["values"]) for m in models.values()):
        errors = defaultdict(float)
        for r in fit.mapInArrow(squares, "width int, at int, v double").groupBy("width", "at").agg(F.sum("v").alias("v")).collect():
            i, j = divmod(r.at, len(models[r.width]["values"]))
            errors[r.width] = max(errors[r.width], abs(r.v / models[r.width]["n"] - (i == j)))
        for width, worst in errors.items():
            models[width]["error"] = worst

    def project(batches):
        for batch in batches:
            for width, of in _by_width(batch):
                model = models[width]
                k = len(model["values"])
                if not k:
                    continue
                centred, w = _scores(of["x"].flatten().to_numpy().reshape(of.num_rows, width), model)
                wide = float((centred.astype(np.float64) ** 2).sum(axis=1).max()) >= 2**62
                squares = (centred.astype(object) if wide else centred) ** 2
                deviation = pa.array([Decimal(int(v)) for v in squares.sum(axis=1)], DECIMAL) if wide else pa.array(squares.sum(axis=1)).cast(DECIMAL)
                at = np.repeat(np.arange(of.num_rows), k)
                part = np.tile(np.arange(k), of.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [of["vec_id"].take(pa.array(at)), pa.array(part + 1, pa.int32()), pa.array(np.full(len(at), model["n"])), deviation.take(pa.array(at)), pa.array(w.ravel()), pa.array(model["shares"][part]), pa.array(np.full(len(at), model["error"]))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")


def _by_width(batch: pa.RecordBatch):
    sizes = np.diff(batch["x"].offsets.to_numpy())
    for width in np.unique(sizes):
        yield int(width), batch.filter(pa.array(sizes == width))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))
