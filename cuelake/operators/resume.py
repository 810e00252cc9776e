"""Sequential folds over ordered rows, run in parallel pieces that are stitched where they agree."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.operators.shared import written

#: Rows of a piece, as a power of two; pieces that are broadcast at most.
PIECE_BITS, FEW = 13, 200_000

Fold = Callable[[pa.Table, bytes | None], tuple[pa.Table, bytes]]


def folded(rows: DataFrame, keys: list[str], order: list[str], fold: Fold, schema: str, *, piece_bits: int | None = None) -> DataFrame:
    """Rows of fold over each group of keys in the order given, with the column _piece.

    fold(table, state) takes consecutive rows of a group and the state before them (None at its start) and
    gives their rows (schema) and the state after them, as bytes. Groups are cut into pieces of 2^piece_bits
    rows, whatever their size. All pieces are folded at once from no state; then a piece is folded again from the state that
    the piece before it ended with, as long as one of those has changed. Folds that forget their
    past at some row end alike whatever they began with, so that this settles after two rounds;
    without that a round settles one piece more. The result is that of the plain fold.
    """
    bits = PIECE_BITS if piece_bits is None else piece_bits
    # the order of all rows gives the pieces: a group with a third of the rows lies in many tasks
    placed = rows.orderBy(*keys, *order).withColumn("_seq", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_piece", F.shiftright("_seq", bits)), "pieces")
    first, last = (f(F.struct(*keys), "_seq") for f in (F.min_by, F.max_by))
    edges = written(placed.groupBy("_piece").agg(first.alias("first"), last.alias("last")), "edges")
    out_type = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_piece", T.LongType()), T.StructField("_state", T.BinaryType())])

    def piece(own: pa.Table, given: pa.Table) -> pa.Table:
        if not own.num_rows or not given.num_rows:
            return pa.Table.from_pylist([], schema=arrow)
        own, state = own.sort_by("_seq"), given["_state"][0].as_py()
        names = list(zip(*(own[k].to_pylist() for k in keys)))
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        made, number = [], own["_piece"][0].as_py()
        for s, e in zip(cuts, cuts[1:]):
            table, state = fold(own.slice(s, e - s), state if s == 0 else None)
            made.append(table if table.schema.equals(inner) else table.cast(inner))
        # the groups of a piece are put together before anything is added to them: most are small
        table = pa.concat_tables(made)
        n = table.num_rows
        table = table.append_column("_piece", pa.array([number] * n, pa.int64())).append_column("_state", pa.nulls(n, pa.binary())).cast(arrow)
        return pa.concat_tables([table, pa.table({f.name: pa.array([number if f.name == "_piece" else state if f.name == "_state" else None], f.type) for f in arrow})])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out_type)
    inner = pa.schema(list(arrow)[:-2])

    def run(todo: DataFrame) -> DataFrame:
        held = placed.join(todo.select("_piece").hint("broadcast" if todo.count() <= FEW else "merge"), "_piece", "left_semi")
        return written(held.groupBy("_piece").cogroup(todo.groupBy("_piece")).applyInArrow(piece, out_type), "folded")

    todo = edges.select("_piece", F.lit(None).cast("binary").alias("_state"))
    given, results, latest, states = todo, [], edges.select("_piece", F.lit(0).alias("round")), None
    while True:
        results.append(run(todo))
        new = results[-1].filter("_state IS NOT NULL").select("_piece", F.col("_state").alias("state"))
        states = new if states is None else written(states.join(new.hint("merge"), "_piece", "left_anti").unionByName(new), "states")
        ends = edges.join(states.hint("merge"), "_piece").select(F.col("last").alias("key"), "_piece", "state", F.lit(1).alias("end"))
        begins = edges.select(F.col("first").alias("key"), "_piece", F.lit(None).cast("binary").alias("state"), F.lit(0).alias("end"))
        before = W.partitionBy("key").orderBy("_piece", "end").rowsBetween(W.unboundedPreceding, -1)
        wanted = ends.unionByName(begins).withColumn("_state", F.last("state", ignorenulls=True).over(before)).filter("end = 0").select("_piece", "_state")
        wanted = written(wanted, "wanted")
        todo = wanted.join(given.withColumnRenamed("_state", "was").hint("merge"), "_piece").filter(~F.col("_state").eqNullSafe(F.col("was"))).drop("was")
        todo, given = written(todo, "todo"), wanted
        if todo.isEmpty():
            break
        again = todo.select("_piece", F.lit(len(results)).alias("round"))
        latest = written(latest.join(again.hint("merge"), "_piece", "left_anti").unionByName(again), "rounds")
    kept = [r.filter("_state IS NULL").join(latest.filter(F.col("round") == n).select("_piece").hint("merge"), "_piece", "left_semi") for n, r in enumerate(results)]
    return reduce(DataFrame.unionByName, kept).drop("_state")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, *, piece_bits: int | None = None) -> DataFrame:
    """Adds the number of each row of its keys in the order given, from 1, without a task that holds all rows of a key.

    All rows are ordered at once; a piece of 2^piece_bits rows numbers its own, and running sums of the pieces'
    counts put them in line.
    """
    bits = PIECE_BITS if piece_bits is None else piece_bits
    placed = rows.orderBy(*keys, *order).withColumn("_seq", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_piece", F.shiftright("_seq", bits)), "numbered")
    counts = placed.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.sum("_n").over(earlier)).filter("_base > 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_at"), "_base")
    own = F.row_number().over(W.partitionBy("_piece", *keys).orderBy("_seq"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_piece") == F.col("_at"))
    joined = placed.withColumn("_own", own).join(base.hint("merge"), same, "left")
    return joined.withColumn(name, F.col("_own") + F.coalesce("_base", F.lit(0))).select(*rows.columns, name)
