"""Exact top-k inner-product search by sequential reads of sorted lists."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.llm.common import staged

#: Candidates of a block of lists, and queries served together.
BLOCK, QUERIES = 4_096, 1_024
#: Depths at which the reading of the lists may stop, as shares of a block.
DEPTHS = (1 / 2, 5 / 8, 3 / 4, 7 / 8)
#: Share of a block's rows that may still qualify when their scores are resolved instead of reading on.
RESOLVE = 1 / 4


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in float64 while every sum is exact there."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[-1]
    if top < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Lists:
    """The sorted lists of a block of rows: one a component, from its largest value.

    step(d) has the terms that the d-th stretch of every list gives, with zeros elsewhere: a
    list is read stretch after stretch, from its top by queries whose weight is positive
    and from its bottom by the others, and no value is read twice.
    """

    def __init__(self, x: np.ndarray, depths: tuple = DEPTHS):
        n = len(x)
        self.x, self.ends = x, sorted({max(1, int(n * d)) for d in depths if n * d < n} | {n})
        order = np.argsort(-x, axis=0, kind="stable")
        self.rank = np.empty(x.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.down = np.take_along_axis(x, order, axis=0).astype(np.float64)

    def step(self, d: int, top: bool) -> np.ndarray:
        low, high = (self.ends[d - 1] if d else 0), self.ends[d]
        at = self.rank if top else len(self.x) - 1 - self.rank
        return np.where((at >= low) & (at < high), self.x, 0).astype(np.float64)

    def unread(self, d: int, top: bool) -> np.ndarray:
        """1.0 for the values that the stretches up to d have not read."""
        at = self.rank if top else len(self.x) - 1 - self.rank
        return (at >= self.ends[d]).astype(np.float64)


def no_random_access(q: np.ndarray, x: np.ndarray, k: int, skip: np.ndarray, bar: np.ndarray | None = None):
    """The k best rows of x for each row of q: (query, row, score, depth read), at most k a
    query and all ties at the k-th; of rows below `bar`, a score that k other rows are
    known to reach, none.

    Every component has one list of the rows, sorted; a query reads it from the top where
    its weight is positive and from the bottom where it is negative. At each depth a
    row's score lies between its seen terms plus the worst and plus the best value that
    the unread part of each list can still hold. Rows whose upper bound is under the k-th
    largest lower bound, or under the bar, are out. A query stops once at most RESOLVE of
    the rows are left; their scores are then resolved.
    skip[i, j]: row j takes no part for query i.
    """
    n, lists = len(x), Lists(x)
    least = np.full(len(q), -np.inf) if bar is None else bar.astype(np.float64)
    pos, neg = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**52
    found, active, seen = [], np.arange(len(q)), np.zeros((len(q), n))
    for d, t in enumerate(lists.ends):
        if not exact or t == n:
            # read to the end: the sums are the scores
            scores = exact_scores(q[active], x)
            scores[skip[active]] = np.iinfo(np.int64).min
            last = np.partition(scores, max(n - k, 0), axis=1)[:, max(n - k, 0)]
            i, j = np.nonzero((scores >= np.maximum(last, least[active])[:, None]) & ~skip[active])
            found.append((active[i], j, scores[i, j], np.ones(len(i))))
            break
        p, m = pos[active], neg[active]
        seen[active] += p @ lists.step(d, True).T + m @ lists.step(d, False).T
        above, below = lists.unread(d, True), lists.unread(d, False)
        best = p @ (above * lists.down[t - 1]).T + m @ (below * lists.down[n - t]).T
        worst = p @ (above * lists.down[-1]).T + m @ (below * lists.down[0]).T
        upper, lower = seen[active] + best, seen[active] + worst
        lower[skip[active]], upper[skip[active]] = -np.inf, -np.inf
        held = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(active), -np.inf)
        may = (upper >= np.maximum(held, least[active])[:, None]) & ~skip[active]
        done = may.sum(axis=1) <= RESOLVE * n
        i, j = np.nonzero(may & done[:, None])
        found.append((active[i], j, np.einsum("ij,ij->i", q[active[i]], x[j]), np.full(len(i), t / n)))
        active = active[~done]
        if not len(active):
            break
    return tuple(np.concatenate(c) for c in zip(*found))


RESULT = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("depth", pa.float64())])


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1).astype(np.int64)


def _cells(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Best rows of each cell: left (vec_id, vector, tag, bar, width, g, b), right (vec_id, vector, width, g, b)."""

    def cell(qs: pa.Table, xs: pa.Table) -> pa.Table:
        if not qs.num_rows or not xs.num_rows:
            return RESULT.empty_table()
        q, x = _matrix(qs["vector"]), _matrix(xs["x"])
        qid, xid, tag = qs["vec_id"].to_numpy(), xs["x_id"].to_numpy(), qs["tag"].to_numpy()
        bar = qs["bar"].to_numpy().astype(np.float64)  # null: -inf
        bar[np.isnan(bar)] = -np.inf
        cut = [slice(s, s + 256) for s in range(0, len(q), 256)]
        out = [no_random_access(q[s], x, min(k, len(x)), qid[s, None] == xid[None, :], bar[s]) for s in cut]
        i = np.concatenate([o[0] + 256 * n for n, o in enumerate(out)])
        j, score, depth = (np.concatenate([o[c] for o in out]) for c in (1, 2, 3))
        order = np.lexsort((xid[j], -score, i))
        i, j, score, depth = i[order], j[order], score[order], depth[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        i, j, score, depth = i[keep], j[keep], score[keep], depth[keep]
        return pa.Table.from_arrays([pa.array(qid[i]), pa.array(tag[i]), pa.array(xid[j]), pa.array(score), pa.array(depth)], schema=RESULT)

    # names of their own: both sides may come from one table
    right = right.select(F.col("vec_id").alias("x_id"), F.col("vector").alias("x"), F.col("width").alias("x_width"), F.col("g").alias("x_g"), F.col("b").alias("x_b"))
    return left.groupBy("width", "g", "b").cogroup(right.groupBy("x_width", "x_g", "x_b")).applyInArrow(cell, "query_id bigint, query bigint, vec_id bigint, score bigint, depth double")


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, *, block: int = BLOCK, together: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score, depth): the k largest inner products of every query.

    queries, rows: (vec_id bigint, vector array<bigint>) without nulls; a query meets the
    rows of its own length. A query's own row, known by its vec_id, takes no part; ties go to the smaller vec_id.
    Rows that repeat id and vector count once; rows with one id and other vectors are kept
    apart and ranked each. An empty side gives an empty table. Scores have 64 bits: vectors
    whose products could exceed them raise an error. depth: the share of the lists read
    before the score was resolved.

    Blocks of `block` rows hold the sorted lists and meet every query in groups of
    `together`: a cell has a bounded size, whatever the table's. The first block of each
    length is searched alone; its k-th score is the bar of each query for all other blocks, which then
    give the few rows that reach it.
    """
    queries, rows = queries.distinct().withColumn("width", F.size("vector")), rows.distinct().withColumn("width", F.size("vector"))
    top = lambda df: df.agg(F.coalesce(F.max(F.aggregate("vector", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v.cast("double"))))), F.lit(0.0)), F.coalesce(F.max("width"), F.lit(0)), F.count("*")).first()
    (q_top, width, n_queries), (x_top, _, n_rows) = top(queries), top(rows)
    if q_top * x_top * width >= 2**63:
        raise ValueError("inner products of these vectors exceed 64 bits")
    blocks, groups = max(1, -(-n_rows // block)), max(1, -(-n_queries // together))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    some = lambda first, n: F.explode(F.sequence(F.lit(first), F.lit(n - 1)))
    left = queries.withColumns({"tag": F.xxhash64("vector"), "g": deal(groups), "bar": F.lit(None).cast("bigint")})
    right = rows.withColumns({"b": deal(blocks), "g": some(0, groups)})
    best = _cells(left.withColumn("b", F.lit(0)), right.filter("b = 0"), k)
    if blocks > 1:
        best = staged(best, "first-block")
        bars = best.groupBy(F.col("query_id").alias("vec_id"), F.col("query").alias("tag")).agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
        left = staged(left.drop("bar").join(bars.hint("merge"), ["vec_id", "tag"], "left"), "queries")
        best = best.unionByName(_cells(left.withColumn("b", some(1, blocks)), right.filter("b > 0"), k))
    order = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")


def integer_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component; rows without id, and vectors
    that are null, empty or hold null or non-finite components, take no part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (
        table.select("vec_id", x.alias("_x")).filter("vec_id IS NOT NULL AND _x IS NOT NULL AND size(_x) > 0").filter(good)
        .select("vec_id", F.transform("_x", lambda v: F.floor(v * scale).cast("bigint")).alias("vector"))
    )


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(rows.filter("vec_id % 20 = 0"), rows).drop("depth")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
