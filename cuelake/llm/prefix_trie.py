"""The trie of conversation prefixes, built in sorted shards under a skeleton of splitter paths."""
from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import staged, words

#: Bytes of a turn in a path.
STEP = 16
#: Turns of a shard aimed at, shards at most, sampled paths a shard, turns of a splitter at most:
#: the skeleton holds SHARDS * DEPTH nodes at most, whatever the table.
TURNS, SHARDS, SAMPLE, DEPTH = 20_000, 2_048, 8, 32
EMPTY = hashlib.sha256(b"").hexdigest()


def _tag(x: Column) -> Column:
    """32 hex digits of a SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 2 * STEP)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): an array a conversation of (tag, words) in the order of turn, null first, then
    by tag. A tag stands for (role, text), null as empty; words counts those of the text.

    A conversation is 40 bytes a turn here; texts are not moved. Rows without conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # one line end cannot stand for two splits: the length of the role comes first
    tag = _tag(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").cast("bigint").alias("turn"), tag.alias("tag"), F.size(words(text)).alias("words")).alias("t"))
    # conversations that may share a head are dealt together: the join with it needs no exchange
    dealt = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).repartition("base")
    held = dealt.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return held.select("base", "conv_id", F.transform("t", lambda x: F.struct(x["tag"].alias("tag"), x["words"].alias("words"))).alias("turns"))


def graft(held: DataFrame) -> DataFrame:
    """Rebuilt conversations: the first h turns of conversation base (all, if it has fewer; none, if it is absent),
    then the conversation's own turns after its first h; h = crc32(decimal conv_id) % 4."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    heads = held.filter("conv_id = base").select("base", F.slice("turns", 1, 3).alias("head"))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    own = F.slice("turns", h + 1, F.size("turns"))
    return held.join(heads.hint("merge"), "base", "left").select("conv_id", F.concat(head, own).alias("turns"))


def endings(rows: DataFrame) -> DataFrame:
    """(key, n, first, ends): for each key of rows (key binary, conv_id) the ids, their number, the smallest,
    and the hash of all in ascending order joined by commas.

    Ids are sorted in their partition and streamed through the hash, batch by batch: a key with
    a third of all conversations is never held at once.
    """

    def stream(batches):
        key, n, first, digest = None, 0, 0, None
        done = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "n", "first", "ends"])

        for batch in batches:
            keys, ids = batch["key"].to_pylist(), batch["conv_id"].to_pylist()
            cuts = [0, *(i for i, (a, b) in enumerate(pairwise(keys), 1) if a != b), len(keys)]
            for s, e in pairwise(cuts):
                if s == e:
                    continue
                if keys[s] != key:
                    if digest:
                        done.append((key, n, first, digest.hexdigest()))
                    key, n, first, digest = keys[s], 0, ids[s], hashlib.sha256()
                digest.update(("," * bool(n) + ",".join(map(str, ids[s:e]))).encode())
                n += e - s
            if len(done) > 10_000:
                yield out()
                done = []
        if digest:
            done.append((key, n, first, digest.hexdigest()))
        if done:
            yield out()

    return rows.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(stream, "key binary, n bigint, first bigint, ends string")


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * STEP] == b[: mid * STEP]:
            low = mid
        else:
            high = mid - 1
    return low


def splitters(sample: list[bytes], shards: int) -> list[bytes]:
    """Ascending paths that cut the sampled ones into about `shards` even parts, each as short
    as keeps its neighbours apart."""
    sample, found = sorted(sample), set()
    for k in range(1, shards):
        at = k * len(sample) // shards
        if 0 < at < len(sample) and sample[at - 1] != sample[at]:
            found.add(sample[at][: (common(sample[at - 1], sample[at]) + 1) * STEP])
    return sorted(found)


class Skeleton:
    """The trie of all proper prefixes of the splitters. Any other node lies in one shard: a splitter parts
    the members of a node only if the node is a proper prefix of it."""

    def __init__(self, cuts: list[bytes]):
        paths = {c[:d] for c in cuts for d in range(0, len(c), STEP)} | {b""}
        self.ids = {p: i for i, p in enumerate(sorted(paths))}
        self.parents = [-1 if not p else self.ids[p[:-STEP]] for p in self.ids]
        self.depths = [len(p) // STEP for p in self.ids]


FIELDS = "node int, parent int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, words bigint"
ARROW = pa.schema([(f.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in FIELDS.split(", ")])


def shard_nodes(batches, skeleton: dict[bytes, int]):
    """Rows of FIELDS for the nodes of sorted shards (shard, path, words, n, first, ends).

    The nodes of the last path stay open. What the next path no longer shares is closed from the
    deepest up; a node hands its sums to its parent and tells its children its smallest member. Nodes of the
    skeleton are closed with what this shard knows of them (node is set); their children leave
    at once, with the parent's number instead of its member.
    """
    out: list[tuple] = []
    stack: list[list] = []  # node, members, smallest, children, leaves, saved, words, ends, rows that wait for the smallest
    path, shard = b"", None

    def close(depth: int) -> None:
        while len(stack) > depth:
            node, n, least, children, leaves, saved, count, ends, waiting = stack.pop()
            d = len(stack)
            if node >= 0:
                out.append((node, None, least, d, None, n, children, leaves, saved, ends, count))
                continue
            leaves, saved = leaves or 1, saved + (n - 1) * count
            out.extend((*row[:4], least, *row[5:]) for row in waiting)
            parent = stack[-1]
            row = (None, parent[0] if parent[0] >= 0 else None, least, d, None, n, children, leaves, saved, ends or EMPTY, count)
            (out if parent[0] >= 0 else parent[8]).append(row)
            parent[1] += n
            parent[2] = least if parent[2] is None else min(parent[2], least)
            parent[3] += 1
            parent[4] += leaves
            parent[5] += saved

    def flush():
        cols = list(zip(*out)) if out else [[]] * len(ARROW)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)
        out.clear()
        return batch

    for batch in batches:
        for at, new, counts, n, first, ends in zip(*(batch[c].to_pylist() for c in ("shard", "path", "words", "n", "first", "ends"))):
            if at != shard:
                close(0)
                shard, path = at, b""
                stack.append([skeleton[b""], 0, None, 0, 0, 0, 0, None, []])
            close(common(path, new) + 1)
            for d in range(len(stack), len(new) // STEP + 1):
                node = skeleton.get(new[: d * STEP], -1) if stack[-1][0] >= 0 else -1
                stack.append([node, 0, None, 0, 0, 0, counts[d - 1], None, []])
            top = stack[-1]
            top[1], top[2], top[7] = top[1] + n, first if top[2] is None else min(top[2], first), ends
            path = new
            if len(out) > 5_000:
                yield flush()
    close(0)
    if out:
        yield flush()


def prefix_trie(conversations: DataFrame, *, sample: int = SAMPLE, turns_a_shard: int = TURNS) -> DataFrame:
    """One row a node of the trie of conversations (conv_id, turns array of (tag, words)): conv_id,
    parent_conv_id (smallest members of the node and of its parent, null for the root), depth, n_convs (members), n_children,
    n_leaves, saved_tokens, ends_sha256.

    A path is the conversation's tags put together. Equal paths are one, with their number and the
    hash of their ids. A sample of paths, drawn in proportion to their turns and bounded by `sample` times the number of
    shards, gives splitters; all of the paths are dealt by them and sorted in their
    shard. Each shard finishes the nodes that it holds alone. Nodes on the way to a splitter
    form the skeleton, which is broadcast; the shards give parts of them, which are added
    up and then summed from the leaves of the skeleton up.

    Conversations without turns end at the root; an empty table has no node, not even the
    root. conv_id must be unique and not null; other columns are dropped. One conversation is one row of
    20 bytes a turn, and as deep a stack in its shard.
    """
    spark = conversations.sparkSession
    paths = staged(conversations.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["tag"]), "")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")).withColumn("key", F.unhex(_tag(F.col("path")))), "paths")
    ends = endings(paths)
    distinct = staged(paths.drop("key").join(ends.hint("merge"), paths["conv_id"] == ends["first"]).select("path", "words", "n", "first", "ends"), "distinct-paths")
    length = F.octet_length("path") / STEP + 1
    total = distinct.agg(F.coalesce(F.sum(length), F.lit(0)).cast("double")).first()[0]
    shards = int(min(SHARDS, max(1, -(-total // turns_a_shard))))
    share = F.lit(sample * shards / max(total, 1.0)) * length
    drawn = distinct.filter(F.pmod(F.xxhash64("path"), F.lit(1 << 30)) < share * (1 << 30)).select(F.substring("path", 1, DEPTH * STEP).alias("path"))
    cuts = splitters([bytes(r.path) for r in drawn.collect()], shards) if shards > 1 else []
    skeleton = Skeleton(cuts)

    def deal(batches):
        for batch in batches:
            at = pa.array([bisect_right(cuts, p) for p in batch["path"].to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([at, *batch.columns], names=["shard", *batch.schema.names])

    dealt = distinct.mapInArrow(deal, "shard int, path binary, words array<int>, n bigint, first bigint, ends string")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "path")
    ids = skeleton.ids
    nodes = staged(dealt.mapInArrow(lambda batches: shard_nodes(batches, ids), FIELDS), "nodes")

    # the skeleton: parts of its nodes added up, then from the deepest up
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = {r.node: r for r in nodes.filter("node IS NOT NULL").groupBy("node").agg(*sums, F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"), F.max("words").alias("words")).collect()}
    held = {i: [0, None, 0, 0, 0] for i in range(len(ids))}
    top = []
    for node in sorted(range(len(ids)), key=lambda i: -skeleton.depths[i]):
        part, h = parts.get(node), held[node]
        if part:
            h[:] = [h[0] + part.n_convs, min((x for x in (h[1], part.conv_id) if x is not None), default=None), h[2] + part.n_children, h[3] + part.n_leaves, h[4] + part.saved_tokens]
        if not h[0]:
            continue
        h[3], h[4] = h[3] or 1, h[4] + (h[0] - 1) * (part.words if part else 0)
        top.append((node, skeleton.parents[node], skeleton.depths[node], *h, (part.ends_sha256 if part else None) or EMPTY))
        if (up := held.get(skeleton.parents[node])) is not None:
            up[:] = [up[0] + h[0], h[1] if up[1] is None else min(up[1], h[1]), up[2] + 1, up[3] + h[3], up[4] + h[4]]
    known = {t[0]: t[4] for t in top}
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    types = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    upper = spark.createDataFrame([(t[4], t[2], known.get(t[1]), t[3], t[5], t[6], t[7], t[8]) for t in top], types)
    smallest = spark.createDataFrame(list(known.items()), "parent int, upper_conv_id bigint")
    lower = nodes.filter("node IS NULL").join(F.broadcast(smallest), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "upper_conv_id"))
    return lower.select(columns).unionByName(upper)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(graft(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))))


#: CRC-32 is folded byte by byte and bit by bit: 3988292384 is its reversed polynomial.
ORACLE = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(role) || ':' || role || text), 1, 32)) AS pos
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) q),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM t) q),
heads AS (SELECT i.conv_id, t.pos, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.base AND t.pos <= i.h),
own AS (SELECT t.conv_id, coalesce(n.n, 0) + t.pos - i.h AS pos, t.role, t.text FROM t JOIN ids i ON i.conv_id = t.conv_id
        LEFT JOIN (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id) n ON n.conv_id = t.conv_id WHERE t.pos > i.h),
rb AS (SELECT conv_id, pos AS depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path,
              len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT * FROM heads UNION ALL SELECT * FROM own) q
       UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
ended AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max(path) AS path FROM rb GROUP BY conv_id) q GROUP BY path),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM rb GROUP BY path, depth),
c AS (SELECT substr(path, 1, (depth - 1) * 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)),
below AS (SELECT rb.path, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved
          FROM f JOIN rb ON rb.conv_id = f.conv_id AND rb.depth <= f.depth GROUP BY rb.path)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(below.n_leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens,
       coalesce(ended.ends, sha256('')) AS ends_sha256
FROM f JOIN below USING (path) LEFT JOIN ended USING (path) LEFT JOIN f p ON f.depth > 0 AND p.path = substr(f.path, 1, (f.depth - 1) * 64)
"""
