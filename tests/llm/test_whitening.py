"""Whitening against exact fractions and a plain covariance."""
import math
from fractions import Fraction

import numpy as np
import pytest

from cuelake.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<double>, label string, x int, width int"


def plain(rows, most=16):
    """Rows (id, vector) by the definition, with Fractions for the moments."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, w = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(w)]
    cov = [[sum((Fraction(x[i]) - Fraction(sums[i], n)) * (Fraction(x[j]) - Fraction(sums[j], n)) for x in fit) / n for j in range(w)] for i in range(w)]
    values, vectors = np.linalg.eigh(np.array(cov, float))
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(most, int((values > 1e-13 * values[0]).sum())) if values[0] > 0 else 0
    out = {}
    for i, x in good:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        mid = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        out.setdefault(i, []).append((n, dev, [float(mid @ vectors[:, k] / math.sqrt(values[k])) for k in range(keep)], [float(v / sum(values)) for v in values[:keep]]))
    return out, keep


def same(got, rows, most=16):
    want, keep = plain(rows, most)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert {i for i, _ in by} == (set(want) if keep else set())
    signs = {}
    for (i, k), held in by.items():
        assert 1 <= k <= keep and len(held) == len(want[i])
        for r, (n, dev, w, share) in zip(sorted(held, key=lambda r: r.deviation), sorted(want[i], key=lambda x: x[1])):
            assert (r.n, int(r.deviation)) == (n, dev)
            assert r.explained == pytest.approx(share[k - 1], rel=1e-9)
            if abs(w[k - 1]) > 1e-6:
                sign = math.copysign(1, r.whitened * w[k - 1])
                assert signs.setdefault(k, sign) == sign
            assert abs(r.whitened) == pytest.approx(abs(w[k - 1]), abs=1e-7)
            assert 0 <= r.identity_error < 1e-8


def test_planes_count_products():
    rng = np.random.default_rng(1)
    for rows, top in ((1, 5), (63, 1), (64, 1000), (65, 2**20), (300, 2**40)):
        y = rng.integers(0, top, (rows, 5))
        want = y.astype(object).T @ y.astype(object)
        assert (np.array(wh.scatter(y)) == want).all()
    assert (np.array(wh.scatter(np.zeros((3, 2), np.int64))) == 0).all()


def test_against_fractions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, list(map(float, rng.normal(size=20) * 0.3 * np.arange(1, 21)))) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(90)] + [(5, rows[5][1])]  # copies and a repeated row
    df = spark.createDataFrame([(i, v, "l", 1, 2) for i, v in rows], SCHEMA).repartition(5)
    got = wh.whiten(df).collect()
    assert len(got) == 16 * len(rows)
    same(got, rows)
    same(wh.whiten(df, most=3).collect(), rows, 3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, nan]), (4, [1.0, None]), (5, [inf, 0.0]), (None, [0.5, 1.0]), (6, [0.25, -1.0]), (7, [0.25, -1.0]), (8, [3.0, 2.0])]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in rows], SCHEMA)
    same(wh.whiten(df).collect(), rows)
    assert wh.whiten(df.limit(0)).collect() == []
    assert wh.whiten(df.filter("vec_id < 6")).collect() == []
    assert wh.whiten(df.filter("vec_id IN (6, 7)")).collect() == []  # one distinct vector: no variance
    # a constant and a repeated dimension have no component of their own
    flat = [(i, [float(i), 7.0, float(i)]) for i in range(10)]
    got = wh.whiten(spark.createDataFrame([(i, v, None, None, None) for i, v in flat], SCHEMA)).collect()
    assert {r.component for r in got} == {1} and all(r.explained == pytest.approx(1) for r in got)
    # every length has its own model
    mixed = rows[5:] + [(20 + i, [float(i % 3), float(i), float(i * i)]) for i in range(9)]
    got = wh.whiten(spark.createDataFrame([(i, v, None, None, None) for i, v in mixed], SCHEMA)).collect()
    same([r for r in got if r.vec_id is None or r.vec_id < 20], mixed[:4])
    same([r for r in got if r.vec_id is not None and r.vec_id >= 20], mixed[4:])
    # squares past 64 bits
    far = [(i, [float(i) * 2.0**38, 1.0 + i % 2]) for i in range(30)]
    same(wh.whiten(spark.createDataFrame([(i, v, None, None, None) for i, v in far], SCHEMA)).collect(), far)
    with pytest.raises(Exception, match="too large"):
        wh.whiten(spark.createDataFrame([(1, [1e300], None, None, None)], SCHEMA)).collect()


def test_query(spark):
    got = wh.op12_embedding_whitening(spark, "/root/testdata/sf0.001")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    out = got.collect()
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and len(out) == 16 * len(rows)
    fit = {tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in rows}
    x = np.array(sorted(fit), float)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    for r in out[:64]:
        assert r.n == len(fit) and r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
