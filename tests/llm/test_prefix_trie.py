"""The prefix trie against a plain one, over several shards and in SQL."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from cuelake.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, path string, n int"


def trunc(c):
    return c - (abs(c) % 20) * (1 if c >= 0 else -1)


def rebuilt(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tag = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            by[c].append((turn is not None, turn or 0, tag, role, text))
    held = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in held}
    return {c: held.get(trunc(c), [])[: h[c]] + v[h[c] :] for c, v in held.items()}


def plain(rows):
    convs = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        count = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * count + sum(saved[k] for k in children[p])
    return sorted(
        (members[p][0], len(p), members[p[:-1]][0] if p else -1, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members
    )


def built(df, **how):
    out = pt.prefix_trie(pt.graft(pt.turns(df)), **how)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out.collect())


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(parts)


def made(seed, n):
    """Conversations with shared heads, copies, a deep one and a hot first turn."""
    r = random.Random(seed)
    rows, pool = [], ["hello there", "", "a b  c\nd", "zzz", None]
    for c in range(n):
        k = r.choice([1, 2, 3, 5, 8])
        turns = [(r.choice(["user", "assistant", None]), r.choice(pool)) for _ in range(k)]
        if c % 3 == 0:
            turns[0] = ("user", "hot turn")
        if c % 5 == 0:
            turns = [("user", "same"), ("assistant", "all the same")]
        rows += [(c, i if i or c % 2 else None, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(n + 7, i, "user", f"turn {i % 4}") for i in range(300)] + [(n + 8, i, "user", f"turn {i % 4}") for i in range(299)]
    return rows


@pytest.mark.parametrize("turns_a_shard", [10, 60, 10**6])
def test_against_plain(spark, turns_a_shard):
    rows = made(3, 240)
    assert built(frame(spark, rows), turns_a_shard=turns_a_shard) == plain(rows)


def test_splitters_cut_between_samples():
    paths = [bytes([a]) * 16 + bytes([b]) * 16 for a in range(4) for b in range(3)]
    cuts = pt.splitters(paths, 6)
    assert cuts == sorted(cuts) and len(cuts) == 5 and all(len(c) in (16, 32) for c in cuts)
    assert pt.splitters([paths[0]] * 50, 8) == []
    assert pt.common(b"", paths[0]) == 0 and pt.common(paths[0], paths[1]) == 1 and pt.common(paths[0], paths[0]) == 2


def test_edges(spark):
    assert built(frame(spark, [(1, 1, "a", "b")]).limit(0)) == []
    # absent base, turnless after its head is cut, negative and null ids, tied and null turns, a role that runs into its text
    rows = [(41, 0, "u", "x"), (-7, 1, "u", "y"), (-7, 1, "u", "x"), (None, 0, "u", "x"), (3, None, None, None), (3, 0, "u", "x"), (8, 0, "1:", "a"), (9, 0, "1", ":a"), (9, 0, "1", ":a")]
    rows += [(c, 0, "u", "one two") for c in range(60, 100)]
    rows.append((200, 0, "u", "w " * 300_000))
    for per in (2, 10**6):
        assert built(frame(spark, rows), turns_a_shard=per) == plain(rows)


def test_hot_copies_and_streams(spark):
    """Thousands of copies of one conversation, over many batches of the stream."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rows = [(c * 20, i, "u", f"t{i}") for c in range(3_000) for i in range(2)] + [(c * 20 + 40_000_000, 0, "u", f"own {c}") for c in range(200)]
        assert built(frame(spark, rows), turns_a_shard=40) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = con.execute(pt.ORACLE).fetchall()
    got = pt.op13_prefix_trie(spark, folder)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(-1 if x is None else x for x in r) for r in want) == plain(rows)
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got.collect()) == plain(rows)
