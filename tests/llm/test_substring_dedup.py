import random
import re

import numpy as np
import pytest

from cuelake.llm import substring_dedup as m


def brute(rows, window):
    keyed = sorted({(d, t) for d, t in rows if d is not None and t})
    out, seen = {}, {}
    # documents of one id follow in the order of their row tags: here ids do not repeat with other texts
    for d, t in keyed:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.setdefault(k, d)
        out[d, t] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    full = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        full.append((d, *out.get((d, t), (len(w), 0, " ".join(w)))))
    return sorted(full, key=str)


@pytest.mark.parametrize("window,gram,buckets", [(20, 4, 3), (20, 4, None), (5, 2, 7)])
def test_equals_brute_force(spark, window, gram, buckets, monkeypatch):
    monkeypatch.setattr(m, "BATCH_CHARS", 3000)
    r = random.Random(3)
    word = lambda: r.choice(["a", "bb", "ccc", "é", "x_y", "日本"]) + str(r.randrange(40))
    passages = [[word() for _ in range(r.choice([19, 20, 21, 60]))] for _ in range(6)]
    rows = [(None, " ".join(passages[3] * 2)), (1, None), (2, ""), (3, " \t\n"), (4, "tie " * 100), (5, "few words only")]
    for i in range(10, 60):
        w = []
        for _ in range(r.randrange(6)):
            w += r.choice(passages) if r.random() < 0.5 else [word() for _ in range(r.randrange(30))]
        rows.append((i, r.choice([" ", "  ", "\n", " \x0b"]).join(w)))
    rows += [rows[20], rows[20]]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id bigint, text string, n_words string").repartition(6)
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.text) for x in m.dedup_substrings(docs, window=window, gram=gram, buckets=buckets).collect()), key=str)
    assert got == brute(rows, window)


def test_unequal_windows_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(m, "shingle_hashes", lambda h, n: np.zeros(max(len(h) - n + 1, 0), np.uint64))
    line = lambda *w: " ".join(w)
    data = m._pack([1, 2, 3, 4], [0, 0, 0, 0], [0, 5, 0, 9], [1, 1, 1, 1], "\n".join([line("a", "b"), line("c", "d"), line("a", "b"), line("c", "d")]))
    assert sorted(map(tuple, m.bucket_repeats([data], 2).T.tolist())) == [(3, 0, 0, 1), (4, 0, 9, 1)]


def test_empty_table(spark):
    assert m.dedup_substrings(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
