"""The border search passes over sizes; it must find what trying every size finds."""
import random

import pytest

from cuelake.functions.similarity import closest_border, common_subsequence, overlap_merge, ratio


def every_size(a, b, join, least, above):
    tried = [(ratio(join.join(a[len(a) - n :]).lower(), join.join(b[:n]).lower()), n) for n in range(least, min(len(a), len(b)) + 1)]
    return max((t for t in tried if t[0] > above), default=(0, 0))[1]


def noisy(rng, text, share, letters):
    return "".join(c if rng.random() > share else rng.choice(["", rng.choice(letters), c + rng.choice(letters)]) for c in text)


@pytest.mark.parametrize("letters", ["ab ", "abcdefghij  ", "ΑΣσ İß ", "你好吗，的 "])
def test_closest_border_equals_every_size(letters):
    rng = random.Random(7)
    for _ in range(150):
        draw = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
        shared = draw(40)
        a, b = draw(60) + shared, noisy(rng, shared, rng.choice([0, 0.1, 0.3]), letters) + draw(60)
        assert closest_border(a, b, "", 3, 0.85) == every_size(a, b, "", 3, 0.85)
        assert closest_border(a.split(), b.split(), " ", 2, 0.8) == every_size(a.split(), b.split(), " ", 2, 0.8)


def test_common_subsequence():
    for a, b, n in (("", "", 0), ("abc", "", 0), ("abcbdab", "bdcaba", 4), ("aaaa", "aa", 2), ("x" * 300, "y" * 300, 0), ("你好", "好你", 1)):
        assert common_subsequence(a, b) == common_subsequence(b, a) == n


def test_merge_cases():
    for a, b, want in (
        (None, "b ", "b"), (" a", "", "a"), ("one two", "two", "one two"), ("one two", "Two three", "one two three"),
        ("we see the sea", "the sea today", "we see the sea today"), ("abc xyz1", "xyz1 def", "abc xyz1 def"),
        ("they walk along the rivver", "along the river bank", "they walk along the river bank"), ("你好", "世界", "你好世界"), ("good", "bye", "good bye"),
    ):
        assert overlap_merge(a, b) == want, (a, b)


def test_long_texts_without_a_border():
    import time

    rng = random.Random(3)
    a, b = (" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(1_000)) for _ in range(2))
    began = time.time()
    assert overlap_merge(a, b) == f"{a} {b}"
    assert time.time() - began < 10


def pairs_of(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").collect()]
    lines = [x for t in texts for x in t.split(". ")][:300]
    rows = list(zip(lines, lines[1:])) + [(x, x[: len(x) * k // 10] + "zz") for k in (5, 7, 9) for x in lines[:60]] + [(x, x) for x in lines[:20]]
    return rows + [("", ""), ("", "a"), (None, "a"), ("a" * 300, "a" * 299), ("ab" * 150, "ba" * 150), ("éé你好", "你好éé"), ("aA", "Aa")]


def test_bounds_settle_pairs_and_change_none(spark):
    from pyspark.sql import functions as F

    from cuelake.functions import similarity as sim

    rows = pairs_of(spark)
    df = spark.createDataFrame(rows, "a string, b string")
    for least in (0.5, 0.78, 0.85, 1.0):
        got = df.select("a", "b", sim.similarity_from(F.col("a"), F.col("b"), least).alias("r"), sim.ratio_bound(F.col("a"), F.col("b")).alias("most")).collect()
        sent = 0
        for r in got:
            if r.a is None:
                assert r.r is None
                continue
            true = sim.ratio(r.a, r.b)
            assert r.most >= true and sim.reaches(r.a, r.b, least) == (true >= least)
            assert r.r == (true if true >= least else None)
            sent += r.a != r.b and r.most >= least
        if least >= 0.78:
            assert sent < 0.7 * len(rows)  # settled in the JVM: the others
