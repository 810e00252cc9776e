"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.llm.common import staged, text_key

#: Documents of a block, slots of a hyperperiod, and documents of a ranking bucket.
BLOCK_DOCS, PERIOD, BUCKET_DOCS = 16, 1_000, 20_000
#: Ranking buckets at most, as many as seven hex digits tell apart: past 5 * 10^12 documents they grow.
MAX_BUCKETS = 1 << 28
#: Slots a source has on the average where there are more sources than slots of a period.
SPREAD = 4
#: Slots that given weights may sum to: they are folded as one period and broadcast.
MAX_PERIOD = 20_000


def target_weights(docs: DataFrame, *, period: int = PERIOD, power: float = 0.5) -> DataFrame:
    """(source, weight): whole slots of each source in a period, in proportion to its
    documents to the given power (tempered sampling). Largest remainders make up the sum;
    every source has one slot at least: with more than `period` sources the period is
    SPREAD times their number."""
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    return apportioned(counts.select(F.lit("").alias("grp"), "source", F.pow("n", F.lit(power)).alias("mass")), period).drop("grp")


def apportioned(units: DataFrame, period: int) -> DataFrame:
    """(grp, source, weight) of units (grp, source, mass): each group shares out its own period."""
    every = W.partitionBy("grp")
    slots = F.when(F.count("*").over(every) <= period, F.lit(period)).otherwise(SPREAD * F.count("*").over(every))
    rows = units.select("grp", "source", slots.alias("p"), ((F.col("mass") / F.sum("mass").over(every)) * (slots - F.count("*").over(every))).alias("x"))
    rows = rows.select("grp", "source", "p", F.floor("x").alias("low"), F.round(F.col("x") - F.floor("x"), 9).alias("part"))
    rows = rows.withColumn("left", F.col("p") - F.sum(F.col("low") + 1).over(every)).withColumn("nth", F.row_number().over(every.orderBy(F.desc("part"), "source")))
    return rows.select("grp", "source", (F.col("low") + 1 + F.when(F.col("nth") <= F.col("left"), 1).otherwise(0)).cast("int").alias("weight"))


def pfair_slots(weights: DataFrame) -> DataFrame:
    """(source, nth, slot, weight, period): the slot of each block of one hyperperiod.

    With weight w of period p, block j (from 1) is released at floor((j - 1) p / w) and due
    at ceil(j p / w). Each slot takes, of the released blocks, that with the earliest
    deadline; ties go to the source first by name. Weights sum to p, so every block meets
    its window and a source is never a whole block from its share. The table has p rows
    and is built by one fold over the slots, whatever the size of the corpus. Where weights
    have a column grp, each group has its own hyperperiod and fold.
    """
    grouped = "grp" in weights.columns
    if not grouped:
        weights = weights.withColumn("grp", F.lit(""))
    one = weights.filter("weight > 0").groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("s"), F.sum("weight").cast("int").alias("p"))
    zero = F.struct(F.transform("s", lambda x: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("slots"))

    def step(state, t):
        ready = F.filter(
            F.transform("s", lambda x, i: F.struct(
                F.ceil((F.get(state["done"], i) + 1) * F.col("p") / x["weight"]).alias("due"), i.alias("i"),
                (F.floor(F.get(state["done"], i) * F.col("p") / x["weight"]) <= t).alias("released"))),
            lambda c: c["released"],
        )
        # array(...) keeps one evaluation of the choice
        return F.get(F.transform(F.array(F.array_min(ready)["i"]), lambda pick: F.struct(
            F.transform(state["done"], lambda d, i: F.when(i == pick, d + 1).otherwise(d)).alias("done"),
            F.concat(state["slots"], F.array(pick)).alias("slots"))), F.lit(0))

    slots = one.select("grp", "s", "p", F.aggregate(F.sequence(F.lit(0), F.col("p") - 1), zero, step, lambda x: x["slots"]).alias("slots"))
    rows = slots.select("grp", "s", "p", F.posexplode("slots").alias("slot", "i")).select("grp", F.get(F.col("s"), F.col("i")).alias("s"), "p", "slot")
    nth = F.row_number().over(W.partitionBy("grp", "source").orderBy("slot"))
    out = rows.select("grp", F.col("s.source").alias("source"), F.col("s.weight").alias("weight"), F.col("p").alias("period"), "slot").withColumn("nth", nth)
    return out if grouped else out.drop("grp")


def slot_lists(slots: DataFrame) -> DataFrame:
    """Slots of each source in one row: grp, source, weight, period, at."""
    at = F.transform(F.sort_array(F.collect_list(F.struct("nth", "slot"))), lambda x: x["slot"])
    return slots.groupBy("grp", "source", "weight", "period").agg(at.alias("at"))


def slot_tables(docs: DataFrame, *, period: int = PERIOD, power: float = 0.5) -> tuple[DataFrame, int]:
    """(w_source, weight_k, period_k, at_k of each level k) and the number of levels.

    Up to `period` sources share one schedule. More are dealt to groups of sources of like
    size, a fixed number each on the average, and the groups, with the sum of their masses,
    are sources of the next level. Block b of a source is the q-th block of its group,
    where q is its slot in the group's schedule, and so on up to the slot of the mixture.
    Each schedule is a fold over its own group, so none grows with the number of sources.
    """
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    units = staged(counts.select("source", F.pow("n", F.lit(power)).alias("mass")), "sources")
    many, most, fan = units.count(), period, max(2, period // (2 * SPREAD))
    levels = []
    while True:
        grouped = None
        if many > most:
            size = units.withColumn("size", F.floor(F.log2("mass")))
            rows = size.groupBy("size").agg(F.ceil(F.count("*") / fan).alias("groups"))
            grouped = staged(size.join(rows.hint("merge"), "size").select(
                F.concat_ws(":", "size", F.pmod(F.xxhash64("source"), "groups")).alias("grp"), "source", "mass"), "groups")
            above = staged(grouped.groupBy("grp").agg(F.sum("mass").alias("mass")).select(F.col("grp").alias("source"), "mass"), "sources")
            fewer = above.count()
            # groups of one source each are not worth a level: the last level takes them as they are
            grouped = grouped if 2 * fewer <= many else None
        last = grouped is None
        level = units.withColumn("grp", F.lit("")) if last else grouped
        levels.append(staged(slot_lists(pfair_slots(staged(apportioned(level, period), "weights"))), "slots"))
        if last:
            break
        units, many, most = above, fewer, period // SPREAD
    table = levels[0].select(F.col("source").alias("w_source"), F.col("grp").alias("_up"), *[F.col(c).alias(f"{c}_0") for c in ("weight", "period", "at")])
    for k, level in enumerate(levels[1:], 1):
        level = level.select(F.col("source").alias("_g"), F.col("grp").alias("_next"), *[F.col(c).alias(f"{c}_{k}") for c in ("weight", "period", "at")])
        table = table.join(level.hint("merge"), F.col("_up") == F.col("_g")).drop("_up", "_g").withColumnRenamed("_next", "_up")
    return table.drop("_up"), len(levels)


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *, block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """Adds source_rank, block, slot and pos: the place of every document in the mixture.

    A source's documents are shuffled by md5(doc_id) and cut into blocks of `block_docs`;
    block b of a source with weight w gets slot pfair(b mod w) + period * (b div w). Ordered
    by (slot, pos), every prefix of slots holds each source within less than one block of
    its target share, until a source ends; the others then go on in their own slots. With
    more than `period` sources they are scheduled in levels (see slot_tables): a source is
    then within less than one block a level. All
    documents are kept. Ranks are counted in hash buckets of a source (BUCKET_DOCS each),
    whose sizes are summed, so that no task holds a source.

    Given weights (source, weight) share one period, their sum: MAX_PERIOD at most, more are an error.
    A null source is the source ''; sources outside `weights` follow the mixture, with
    null slots. Null ids and rows that repeat an id are ordered by their texts. Input columns
    with the added names are replaced; an empty table gives an empty table.
    """
    docs = docs.drop("source_rank", "block", "slot", "pos")
    if weights is None:
        table, levels = slot_tables(docs, period=period)
    else:
        total = weights.filter("weight > 0").agg(F.coalesce(F.sum(F.col("weight").cast("bigint")), F.lit(0))).first()[0]
        if total > MAX_PERIOD:
            raise ValueError(f"weights sum to {total} slots; divide them, so that they sum to {MAX_PERIOD} or less")
        slots = slot_lists(staged(pfair_slots(weights.select("source", "weight", F.lit("").alias("grp"))), "slots"))
        table, levels = slots.select(F.col("source").alias("w_source"), *[F.col(c).alias(f"{c}_0") for c in ("weight", "period", "at")]), 1
    buckets = min(MAX_BUCKETS, max(1, -(-docs.count() // BUCKET_DOCS)))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bucket = lambda k: F.floor(F.conv(F.substring(k, 1, 7), 16, 10).cast("bigint") * buckets / MAX_BUCKETS).cast("int")
    keyed = docs.withColumns({"_s": F.coalesce("source", F.lit("")), "_k": key, "_b": bucket(key), "_t": text_key(F.col("text"))})
    sizes = keyed.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_s").alias("s"), F.col("_b").alias("b"), F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # the slots of one level are bounded (a period); those of many sources meet their source's few bucket rows, not its documents
    if levels > 1:
        before = before.join(table.hint("merge"), F.col("s") == F.col("w_source"), "left")
    ranked = (
        keyed.withColumn("_r", F.row_number().over(W.partitionBy("_s", "_b").orderBy("_k", "doc_id", "_t")))
        .join(before.hint("merge"), (F.col("_s") == F.col("s")) & (F.col("_b") == F.col("b")))
        .withColumn("source_rank", F.col("base") + F.col("_r") - 1)
        .withColumn("block", F.floor(F.col("source_rank") / block_docs))
    )
    placed = ranked if levels > 1 else ranked.join(F.broadcast(table), F.col("_s") == F.col("w_source"), "left")
    slot = F.col("block")
    for k in range(levels):
        placed = placed.withColumn(f"_slot_{k}", F.get(F.col(f"at_{k}"), (slot % F.col(f"weight_{k}")).cast("int")) + F.floor(slot / F.col(f"weight_{k}")) * F.col(f"period_{k}"))
        slot = F.col(f"_slot_{k}")
    return placed.withColumns({"slot": slot, "pos": (F.col("source_rank") % block_docs).cast("int")}).select(*docs.columns, "source_rank", "block", "slot", "pos")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).drop("text")


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
c AS (SELECT s, count(*) AS n FROM d GROUP BY s),
h AS (SELECT s, pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * ({PERIOD} - count(*) OVER ()) AS x FROM c),
f AS (SELECT s, CAST(floor(x) AS BIGINT) AS low, round(x - floor(x), 9) AS part FROM h),
w AS (SELECT s, low + 1 + CASE WHEN row_number() OVER (ORDER BY part DESC, s) <= {PERIOD} - sum(low + 1) OVER () THEN 1 ELSE 0 END AS weight FROM f),
e AS (SELECT list(s ORDER BY s) AS names, list(CAST(weight AS BIGINT) ORDER BY s) AS ws FROM w),
r AS (SELECT 0 AS t, names, ws, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM e
      UNION ALL
      SELECT t + 1, names, ws,
             list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p
      FROM (SELECT *, CAST(list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda i: (done[i] * {PERIOD}) // ws[i] <= t),
                     lambda i: ((done[i] + 1) * {PERIOD} + ws[i] - 1) // ws[i] * 100000 + i)) % 100000 AS BIGINT) AS p FROM r WHERE t < {PERIOD}) q),
g AS (SELECT names[pick] AS s, ws[pick] AS weight, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM r WHERE t > 0),
m AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY k, doc_id) - 1 AS source_rank FROM d),
b AS (SELECT *, source_rank // {BLOCK_DOCS} AS block FROM m)
SELECT b.doc_id, b.source, b.source_rank, b.block, g.slot + (b.block // g.weight) * {PERIOD} AS slot, CAST(b.source_rank % {BLOCK_DOCS} AS INTEGER) AS pos
FROM b JOIN g ON g.s = b.s AND g.nth = b.block % g.weight
"""
