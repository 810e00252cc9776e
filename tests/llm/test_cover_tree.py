"""Near-duplicate embeddings against all pairs."""
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from cuelake.llm import cover_tree as ct

SCHEMA = "vec_id bigint, embedding array<double>, cell string, k int, x int"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, "c", 1, 2) for i, v in rows], SCHEMA).repartition(parts)


def plain(rows, cosine=0.9):
    """Sorted rows (vec_id, n_links, component_id, kept) for unique ids; vectors that cannot link stand alone."""
    def good(v):
        return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    ids = [i for i, _ in rows]
    ok = [n for n, (i, v) in enumerate(rows) if i is not None and good(v)]
    parent = list(range(len(rows)))

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    count = [0] * len(rows)
    by = {}
    for n in ok:
        by.setdefault(len(rows[n][1]), []).append(n)
    for held in by.values():
        u = ct.unit(np.array([rows[n][1] for n in held], float))
        cos = u @ u.T
        for p in range(len(held)):
            for q in np.flatnonzero(cos[p] >= cosine - 1e-12).tolist():
                if q > p and (cos[p, q] > cosine + 1e-12 or ct.reaches(np.array(rows[held[p]][1]), np.array(rows[held[q]][1]), Fraction(str(cosine)))):
                    a, b = held[p], held[q]
                    count[a] += 1
                    count[b] += 1
                    x, y = sorted((find(a), find(b)), key=lambda n: ids[n])
                    parent[y] = x
    return sorted(((i if i is not None else -10**9), count[n], ids[find(n)] if i is not None else -10**9, i is None or ids[find(n)] == i) for n, (i, _) in enumerate(rows))


def got(df, **how):
    out = ct.near_vectors(df, **how)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    none = lambda x: -10**9 if x is None else x
    return sorted((none(r.vec_id), r.n_links, none(r.component_id), r.kept) for r in out.collect())


def made(seed, n, width):
    """Directions at random, balls of many spreads, a hot ball with a third of all rows, scaled and exact copies."""
    r = np.random.default_rng(seed)
    rows = [r.normal(size=width) for _ in range(n // 3)]
    hot = r.normal(size=width)
    rows += [hot + r.normal(size=width) * 0.12 * np.linalg.norm(hot) / math.sqrt(width) * (1 + i % 4) for i in range(n // 3)]
    while len(rows) < n:
        base, spread = rows[r.integers(len(rows))], r.choice([0, 1e-9, 0.01, 0.2, 0.45, 0.5, 0.6])
        rows.append(base * r.choice([1.0, 1.0, 3.0]) + spread * np.linalg.norm(base) * r.normal(size=width) / math.sqrt(width))
    ids = r.permutation(n) - 5
    return [(int(i), list(map(float, v))) for i, v in zip(ids, rows)]


@pytest.mark.parametrize("leaf,fan,width", [(8_192, 64, 64), (60, 4, 16), (25, 3, 3)])
def test_against_all_pairs(spark, leaf, fan, width):
    rows = made(leaf, 700, width)
    assert got(frame(spark, rows), leaf=leaf, fan=fan) == plain(rows)


@pytest.mark.parametrize("cosine", [0.5, 0.99, 1.0])
def test_other_limits(spark, cosine):
    rows = made(9, 300, 8)
    if cosine == 1.0:  # equal directions in whole numbers
        rows = [(i, [float(round(c * 2)) for c in v]) for i, v in rows]
    assert got(frame(spark, rows), cosine=cosine, leaf=40, fan=3) == plain(rows, cosine)


def test_tree_covers():
    u = ct.unit(np.array([v for _, v in made(4, 600, 12)]))
    tree, order = ct.Tree.grown(u)
    assert sorted(order) == list(range(600)) and np.array_equal(tree.u, u[order])
    for level, (starts, ends, radii) in enumerate(zip(tree.starts, tree.ends, tree.radii)):
        assert starts[0] == 0 and (ends > starts).all()
        for s, e, r in zip(starts, ends, radii):
            assert np.linalg.norm(tree.u[s:e] - tree.u[s], axis=1).max() <= r + 1e-9 and r <= ct.RADII[0] + 1e-6
        if level:
            assert set(tree.starts[level - 1]) <= set(starts) and tree.radii[level - 1].max() >= radii.max()  # nested
    assert tree.radii[-1].max() <= ct.RADII[-1] + 1e-6


def test_traverse_counts_whole_nodes():
    """A tight ball is settled by its radius, without its pairs."""
    r = np.random.default_rng(5)
    x = r.normal(size=8) + 1e-4 * r.normal(size=(400, 8))
    tree, order = ct.Tree.grown(ct.unit(x))
    calls = []
    original = ct.Links.pairs
    ct.Links.pairs = lambda self, p, q: calls.append(len(p)) or original(self, p, q)
    try:
        count, label = ct.traverse(tree, tree, x[order], x[order], np.full(400, 2), 0.9)
    finally:
        ct.Links.pairs = original
    assert (count == 2 * 399).all() and (label == 0).all() and not calls


def test_limit_is_exact(spark):
    # cos = 9/10 and just below, in whole numbers: (9, 0, ...) against (9, a, b, ..) with 81 + ... = 100
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [9.0, 3.0, 3.0, 1.0]), (2, [0.9, 0.3, 0.3, 0.1]), (3, [-9.0, 3.0, 3.0, 1.0]), (4, [9e200, 3e200, 3e200, 1e200]), (5, [9e-200, 3e-200, 3e-200, 1e-200])]
    out = got(frame(spark, rows))
    assert out == plain(rows)
    assert {i: n for i, n, *_ in out}[1] == 4  # 9/10 itself is a link


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, nan]), (4, [1.0, None]), (5, [inf, 0.0]), (6, [0.0, 0.0]), (7, [0.0, -0.0]), (8, [1.0, 0.0]), (9, [1.0, -0.0]), (10, [2.0, 0.1]), (11, [1.0]), (12, [1.0, 0.0, 0.0]), (-4, [1.0, 0.2])]
    df = frame(spark, rows)
    assert got(df) == plain(rows)
    assert got(df.limit(0)) == []
    assert got(df.filter("vec_id BETWEEN 0 AND 7")) == plain(rows[:7])
    # repeated rows count once, rows without id link with nothing, an id with two vectors has two rows
    more = got(df.union(df.filter("vec_id = 8")).union(frame(spark, [(None, [1.0, 0.0]), (8, [0.0, 1.0])])))
    want = sorted([*plain(rows), (-10**9, 0, -10**9, True), (8, 0, 8, True)])
    assert more == want
    with pytest.raises(ValueError):
        ct.near_vectors(df, cosine=0)


def test_copies_of_one_vector(spark):
    """Thousands of equal vectors, and cells that lie on one spot."""
    rows = [(i, [1.0, 2.0]) for i in range(2_000)] + [(5_000 + i, [float(i + 1), 2.0 * (i + 1)]) for i in range(300)]
    out = got(frame(spark, rows), leaf=50, fan=3)
    assert out == [(i, 2_299, 0, i == 0) for i, _ in rows]


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(con.execute(ct.ORACLE).fetchall())
    assert sorted(tuple(r) for r in ct.op11_embedding_near_dedup(spark, folder).collect()) == want
    rows = [(i, v) for i, v in made(11, 150, 6)]
    con.execute("CREATE OR REPLACE TABLE t (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO t VALUES (?, ?)", [list(r) for r in rows])
    con.execute("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM t")
    assert sorted(con.execute(ct.ORACLE).fetchall()) == plain(rows)


def opened(monkeypatch, tree, x):
    """(linked vectors of each, pairs whose cosines were taken one by one) of a tree with itself."""
    taken, original = [], np.einsum

    def counted(how, p, q):
        taken.append(len(p) if p is not q else 0)
        return original(how, p, q)

    monkeypatch.setattr(ct.np, "einsum", counted)
    count, _ = ct.traverse(tree, tree, x, x, np.ones(len(x), np.int64), 0.9)
    monkeypatch.setattr(ct.np, "einsum", original)
    return count, sum(taken)


@pytest.mark.parametrize("spread,scale", [(0.75, None), (0.0, slice(0, 32)), (0.0, slice(16, 64))])
def test_wide_levels_cost_no_pairs(monkeypatch, spread, scale):
    """Nodes that are joined, but too wide to be dropped, are not a level: nearly all pairs stay in blocks."""
    r = np.random.default_rng(3)
    x = spread * r.normal(size=64) + r.normal(size=(1_500, 64))
    if scale:
        x[:, scale] *= 0.05
    x[700:720] = x[:20] + 0.02 * r.normal(size=(20, 64))
    u = ct.unit(x)
    tree, order = ct.Tree.grown(u)
    count, taken = opened(monkeypatch, tree, x[order])
    assert (count == ((u @ u.T >= 0.9).sum(axis=1) - 1)[order]).all() and count.sum() >= 40
    assert taken < 0.02 * len(x) ** 2 / 2


def test_levels_that_drop_pairs_stay():
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 64))[r.integers(40, size=1_600)] + 0.1 * r.normal(size=(1_600, 64))
    tree, _ = ct.Tree.grown(ct.unit(x))
    assert len(tree.starts[0]) < 100 < len(tree.starts[-1])


def test_leading_components_bound_the_cosine():
    u = ct.unit(np.array([v for _, v in made(6, 400, 24)]))
    tree, _ = ct.Tree.grown(u)
    for k in (1, 8, 23, 24, 90):
        assert (tree.lead(k) @ tree.lead(k).T >= tree.u @ tree.u.T - ct.ROUND).all()


def test_few_entries_of_a_mask():
    r = np.random.default_rng(1)
    for share in (0, 0.01, 0.5, 1):
        mask = r.random(800) < share
        assert np.array_equal(ct.held(mask), np.flatnonzero(mask))


@pytest.mark.parametrize("width,wide", [(8, 5), (600, 1)])
def test_cells_are_sent_once_a_tile(spark, width, wide):
    n = 160
    names = [f"{width}.{i}" for i in range(n)]
    pairs = [(a, b) if (i + j) % 3 else (b, a) for i, a in enumerate(names) for j, b in enumerate(names[: i + 1])]
    out = ct.tiled(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame([(c,) for c in names], "cell string")).collect()
    assert sorted(tuple(sorted((r.cell, o))) for r in out for o in r.others) == sorted(tuple(sorted(p)) for p in pairs)
    held = {}
    for r in out:
        held.setdefault((r.left, r.right), set()).add(r.cell)
    assert all(r.cell in held[r.left, r.right] and set(r.others) <= held[r.left, r.right] for r in out)
    assert len(out) == sum(map(len, held.values()))  # a cell once a pair of tiles
    tiles = n // wide
    assert len(held) == tiles * (tiles + 1) // 2 and max(map(len, held.values())) == 2 * wide


@pytest.mark.parametrize("spread", [0.25, 0.33])
def test_dense_links_are_counted_as_a_matrix(spread):
    """A ball whose vectors are nearly all linked, but wider than the limit, is not taken link by link."""
    r = np.random.default_rng(8)
    x = np.array([1.0, 0, 0, 0]) + spread * r.normal(size=(900, 4))
    at_limit = [[9.0, a * p, b * q, c * s] for a, b, c in ((3, 3, 1), (3, 1, 3), (1, 3, 3)) for p in (1, -1) for q in (1, -1) for s in (1, -1)]
    x = np.concatenate((x, [[1.0, 0, 0, 0], [2.0, 0, 0, 1e-13], [-1.0, 0.1, 0, 0]], at_limit))
    want = [(n, k, c) for n, k, c, _ in plain([(n, v.tolist()) for n, v in enumerate(x)])]
    tree, order = ct.Tree.grown(ct.unit(x))
    tree = ct.Tree(tree.u, [np.arange(len(x))], [np.zeros(len(x))])  # single vectors alone
    calls, original = [], ct.Links.pairs
    ct.Links.pairs = lambda self, p, q: calls.append(len(p)) or original(self, p, q)
    try:
        count, label = ct.traverse(tree, tree, x[order], x[order], np.ones(len(x), np.int64), 0.9)
        half = len(x) // 2
        a, b = (ct.Tree(tree.u[s], [np.arange(len(tree.u[s]))], [np.zeros(len(tree.u[s]))]) for s in (slice(half), slice(half, None)))
        cross, _ = ct.traverse(a, b, x[order][:half], x[order][half:], np.ones(len(x), np.int64), 0.9)
        ends = [ct.traverse(t, t, v, v, np.ones(len(v), np.int64), 0.9)[0] for t, v in ((a, x[order][:half]), (b, x[order][half:]))]
    finally:
        ct.Links.pairs = original
    least = {}
    for n, c in zip(order.tolist(), label.tolist()):
        least[c] = min(n, least.get(c, n))
    assert sorted(zip(order.tolist(), count.tolist(), (least[c] for c in label.tolist()))) == want
    assert (cross + np.concatenate(ends) == count).all()
    assert sum(calls) < 0.1 * count.sum()
