"""Dictionaries of any size against plain searches and folds."""
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as t
from cuelake.operators import lexicon as lex
from cuelake.operators import trie

PAIRS = "ord int, key string, value string"


@pytest.fixture(params=[200_000, 2], ids=["one shard", "many shards"])
def shard(request, monkeypatch):
    monkeypatch.setattr(trie, "SHARD", request.param)


def some_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("aabbcé😀 你好x") for _ in range(r.randrange(0, 40))) for _ in range(n)] + ["", None, "a" * 50]


def test_terms_against_count(spark, shard):
    texts, terms = some_texts(1, 300), ["a", "aa", "aba", "b", "é😀", "你好", "x" * 60, "", "好x", "zzz"]
    df = spark.createDataFrame([(i, x, "extra", 1) for i, x in enumerate(texts)], "id int, text string, term string, n int").repartition(3)
    got = sorted(tuple(r) for r in lex.find_terms(df, spark.createDataFrame([(x,) for x in [*terms, None, "a"]], "term string")).collect())
    assert got == sorted((i, x, s.count(x)) for i, s in enumerate(texts) if s for x in terms if x and x in s)
    assert lex.find_terms(df.limit(0), spark.createDataFrame([("a",)], "term string")).collect() == []
    assert lex.find_terms(df, spark.createDataFrame([], "term string")).collect() == []


@pytest.mark.parametrize("limit", [None, 1, 3])
def test_replacement_equals_the_fold(spark, shard, limit):
    """Values that bring earlier and later keys, repeated keys, empty keys and values, ties of length."""
    pairs = [(0, "ab", "ba"), (1, "ba", "xa"), (2, "a", "bb"), (3, "b", "é"), (4, "é😀", "你好ab"), (5, "你好", ""), (6, "a", "你"), (7, "", "never"), (8, "好", "aba"), (9, "xab", "x")]
    df = spark.createDataFrame([(x,) for x in some_texts(2, 200)], "text string").repartition(3)
    table = spark.createDataFrame(pairs, PAIRS)
    want = {r.text: r.out for r in df.withColumn("p", lex.pairs_array(table, -F.length("key"), F.col("ord"))).select("text", t.replace_in_order(F.col("text"), F.col("p"), limit).alias("out")).collect()}
    assert {r.text: r.out for r in lex.replace_longest(df, table, limit).collect()} == want


def test_mask_equals_the_fold(spark, shard):
    texts, terms = some_texts(3, 150), ["ab", "aab", "你好", "é", "zz"]

    def plain(x):
        for k in sorted(terms, key=lambda k: (-len(k), k)):
            x = x.replace(k, "***")
        return x

    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = {r.text: (r.hits, r.out) for r in lex.mask_terms(df, spark.createDataFrame([(x,) for x in terms], "term string")).collect()}
    assert got == {x: (0, None) if x is None else (sum(k in x for k in terms), plain(x)) for x in texts}


def test_lexicon_of_full_size(spark):
    """115,368 phrases in one replacement, as many as the largest dictionary in use."""
    r = random.Random(4)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 3_000)]
    keys = list(dict.fromkeys("".join(r.choice(alphabet) for _ in range(r.choice([1, 2, 2, 3, 4]))) for _ in range(160_000)))[:115_368]
    assert len(keys) == 115_368
    value = {k: f" w{i} " for i, k in enumerate(keys)}
    texts = ["".join(r.choice(alphabet) for _ in range(60)) + r.choice(keys) for _ in range(40)]

    def plain(x, limit):
        n = 0
        for k in sorted(keys, key=lambda k: (-len(k), order[k])):
            if k in x:
                x, n = x.replace(k, value[k]), n + 1
                if n >= limit:
                    break
        return x

    order = {k: i for i, k in enumerate(keys)}
    table = spark.createDataFrame([(i, k, value[k]) for i, k in enumerate(keys)], PAIRS)
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = {r.text: r.out for r in lex.replace_longest(df, table, 50).collect()}
    assert all(got[x] == plain(x, 50) for x in texts[:6]) and len(got) == len(set(texts))
    found = lex.find_terms(df.select(F.col("text").alias("id"), "text"), table.select(F.col("key").alias("term")))
    by = {}
    for x in found.collect():
        by.setdefault(x.id, set()).add(x.term)
    assert all(by[x] == {k for k in keys if k in x} for x in texts[:6])


def test_time_follows_the_text():
    keys = [chr(97 + a) + chr(97 + b) + chr(97 + c) for a in range(26) for b in range(26) for c in range(26)]
    edges, first, count, by = trie.Trie.built(keys, np.arange(len(keys)))
    held = trie.Trie(edges, first, count, np.arange(len(keys))[by], [keys[i] for i in by], [""] * len(keys))

    class One:
        shards, present = 1, frozenset([0])
        shard = staticmethod(lambda n: held)
        tries, matches = trie.Dictionary.tries, trie.Dictionary.matches

    r, took = random.Random(5), []
    for n in (200_000, 400_000, 800_000):
        text = "".join(r.choice("abcdefgh ") for _ in range(n))
        begun = time.process_time()
        row, terms, counts = trie.counted(One(), [text])
        took.append(time.process_time() - begun)
        assert all(c == text.count(x) for x, c in list(zip(terms, counts))[:40])
    assert took[2] < 8 * max(took[0], 0.02)  # a quadratic search would take 16 times as long


def test_longest_match_over_shards(spark, shard):
    lexicon = spark.createDataFrame([("你好", "xin"), ("你", "ban"), ("好吗", "khong"), ("😀x", "smile"), ("é", "e")], "key string, value string")
    texts = ["你好吗", "你 好吗", "a你b", "😀x😀", "éé", "", None, "abc 12", "好"]
    got = {r.text: r.out for r in lex.translate_longest(spark.createDataFrame([(x,) for x in texts], "text string"), lexicon).collect()}
    assert got == {"你好吗": "xin 吗", "你 好吗": "ban khong", "a你b": "a ban b", "😀x😀": "smile 😀", "éé": "e e", "": "", None: None, "abc 12": "abc 12", "好": "好"}
