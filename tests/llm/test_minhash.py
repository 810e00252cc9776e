import random
import re
from itertools import combinations

import numpy as np
import pytest

from cuelake.llm import minhash as m


def sets_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        out.append((doc, set(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute(rows):
    sets = sets_of(rows)
    up = {d: d for d, _ in sets if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= 85 * len(x | y):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return sorted(((d is None, d, len(s), top(d) if d is not None else None, d is None or top(d) == d) for d, s in sets), key=str)


def cases():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(400)]
    rows = [(5, None), (6, ""), (7, " \n "), (8, "Two words"), (9, "two  WORDS"), (10, "two wordS more"), (None, "two words"), (11, "x " * 4000), (12, "X " * 30)]
    for i in range(60):  # spokes near the hub 1000, not near each other
        w = list(base)
        for k in r.sample(range(400), 6):
            w[k] = word()
        rows.append((100 + i, " ".join(w)))
    rows.append((1000, " ".join(base)))
    for n in (8, 20, 60, 70, 90, 300):  # chains
        w = [word() for _ in range(n)]
        for i in range(8):
            rows.append((2000 + 100 * n + i, " ".join(w)))
            w = list(w)
            w[r.randrange(n)] = word()
            w.append(word())
    rows += [(3, " ".join(base)), (3, " ".join(base)), (4, "ties go here one two three"), (2, "ties go here one two three")]
    return rows


@pytest.mark.parametrize("few,block", [(0, 3), (0, 1000), (64, 1024)])
def test_components_equal_brute_force(spark, few, block, monkeypatch):
    monkeypatch.setattr(m, "FEW", few)
    monkeypatch.setattr(m, "BLOCK", block)
    rows = cases()
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id bigint, text string, kept string")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, least in ((40, 0.2), (500, 0.12)):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[: n - n // 10], rng.integers(0, 2**63, n // 10).astype(np.uint64) * np.uint64(2))))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((m.signature(a) == m.signature(b)).mean() - j) < least


@pytest.mark.parametrize("percent", [80, 85])
def test_recall_of_bands_by_set_size(percent):
    """Share of pairs just at the threshold that meet in a bucket: over 0.99 at every size."""
    rng = np.random.default_rng(3)
    fresh = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
    for n in (4, 6, 8, 10, 15, 20, 30, 50, 80, 150, 500, 3000):
        met = tried = 0
        for _ in range(300):
            a = fresh(n)
            gone = next(g for g in range(len(a), -1, -1) if 100 * (len(a) - g) >= percent * (len(a) + g))  # replaced in b
            b = np.unique(np.concatenate((a[gone:], fresh(gone))))
            met += len(np.intersect1d(m.bands(m.signature(a)), m.bands(m.signature(b)))) > 0
            tried += 1
        assert met >= 0.99 * tried, (n, met, tried)
