"""run() against a plain Python version of its stages on a small fixture."""
import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest

pytest.importorskip("tiktoken")
xxhash = pytest.importorskip("xxhash")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from cuelake.llm import bpe, quality  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def signed(n):
    return n - 2**64 if n >= 2**63 else n


def grams(text):
    tokens = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+|[!-/:-@\[-`{-~]+", (text or "").lower())
    h = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in tokens]
    two = [signed(xxhash.xxh64_intdigest((b & (2**64 - 1)).to_bytes(8, "little"), xxhash.xxh64_intdigest((a & (2**64 - 1)).to_bytes(8, "little"), 42))) for a, b in zip(h, h[1:])]
    return [x % quality.BUCKETS for x in h + two]


def kept_by_quality(docs, trusted):
    raw, target = Counter(), Counter()
    for d, t in docs:
        raw.update(grams(t))
        if d in trusted:
            target.update(grams(t))
    n = quality.BUCKETS
    all_raw, all_target = sum(raw.values()) + n, sum(target.values()) + n
    llr = [math.floor((math.log((target[b] + 1) / all_target) - math.log((raw[b] + 1) / all_raw)) * 1e6 + 0.5) for b in range(n)]
    out = []
    for d, t in docs:
        w, g = WORD.findall(t or ""), grams(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = set()
        for i in range(len(w) - 7):
            if windows[tuple(w[i : i + 8])] > 1:
                covered.update(range(i, i + 8))
        score = sum(llr[b] for b in g) / len(g) / 1e6 if g else 0.0
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and score >= quality.THRESHOLD:
            out.append((d, t))
    return out


def without_lines(docs):
    owner = {}
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOW)
    for d, t in sorted(docs):
        for x in t.split("\n"):
            owner.setdefault(key(x), d)
    return [(d, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == d)) for d, t in docs]


def one_of_each(docs):
    sets = {}
    for d, t in docs:
        w = WORD.findall(t.translate(LOW))
        sets[d] = set(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) >= 5 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return [(d, t) for d, t in docs if top(d) == d]


def test_run_equals_plain_python(spark, tmp_path):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    clean = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = clean(9)
    docs = [(i, "\n".join(clean(r.randrange(8, 60)) for _ in range(4)) + ("\n" + shared if i % 3 == 0 else "")) for i in range(80)]
    docs += [(100 + i, docs[i][1]) for i in range(10)]
    docs += [(120 + i, docs[i][1] + " one more") for i in range(10, 20)]
    docs += [(140 + i, " ".join(f"{w}%%% ***" for w in clean(60).split())) for i in range(8)]
    docs += [(160, "few words"), (161, None), (162, ""), (163, "again and " * 50), (164, clean(40) + "\n" + clean(40))]
    rows = [(d, t, "en", f"src{d % 5 if d % 3 else 0}", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 80, 2)] + [(140, 0, 0), (1, 1, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    want = one_of_each(without_lines(kept_by_quality(docs, {d for d, q, t in labels if q and not t})))
    enc = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).encoding
    expected = sorted((d, enc.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in want)
    got = sorted((x.doc_id, list(x.ids), x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == expected
    assert 60 < len(got) < len(docs) - 20


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot int, kept int, n_words int"
    for data in ([], [(1, "a b " * 30, None, None, None, 1, 1, 1), (None, None, None, None, None, 1, 1, 1), (2, "", None, "s", 0, 1, 1, 1)]):
        docs = spark.createDataFrame(data, kind)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS
            assert stage(spark, docs, str(tmp_path)).count() <= len(data)


def places(docs, period, block_docs):
    """(doc_id, slot, pos) by plain Pfair scheduling of (doc_id, source)."""
    by = {}
    for d, s in docs:
        by.setdefault(s or "", []).append(d)
    names, total = sorted(by), sum(len(x) ** 0.5 for x in by.values())
    x = {s: len(by[s]) ** 0.5 / total * (period - len(by)) for s in names}
    weight = {s: math.floor(x[s]) + 1 for s in names}
    rest = period - sum(weight.values())
    for s in sorted(names, key=lambda s: (-round(x[s] - math.floor(x[s]), 9), s))[:rest]:
        weight[s] += 1
    at, done = {s: [] for s in names}, dict.fromkeys(names, 0)
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // weight[s]), s) for s in names if done[s] * period // weight[s] <= t]
        s = min(ready)[1]
        at[s].append(t)
        done[s] += 1
    out = []
    for s, ids in by.items():
        for rank, d in enumerate(sorted(ids, key=lambda d: hashlib.md5(str(d).encode()).hexdigest())):
            block = rank // block_docs
            out.append((d, s, at[s][block % weight[s]] + period * (block // weight[s]), rank % block_docs))
    return sorted(out)


def test_run_returns_the_places_of_the_mixture(spark, tmp_path):
    docs = [(i, f"text {i} " * (1 + i % 5), f"src{i % 4 if i % 3 else 0}") for i in range(300)]
    docs += [(400, "long text of many words " * 4_000, "src1"), (401, "long text of many words " * 4_000, None)]
    frame = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[3:]:
        frame = corpus_pipeline.staged(stage(spark, frame, str(tmp_path)), name.replace(" ", "-"))
    got = frame.collect()
    enc = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).encoding
    assert sorted((r.doc_id, r.source or "", r.slot, r.pos) for r in got) == places([(d, s) for d, _, s in docs], 1_000, 16)
    assert {r.doc_id: list(r.ids) for r in got} == {d: enc.encode_ordinary(t) for d, t, _ in docs}


def test_copies_of_long_texts_keep_their_places(spark):
    rows = [(i % 2 or None, "abc def " * 20, k) for k, i in enumerate([0, 0, 1, 1, 1])] + [(7, "short", 9)]
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id bigint, text string, slot int"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), chunk=64, overlap=16, carry=("slot",)).collect()
    assert sorted((r.doc_id or 0, r.slot, r.decoded.decode()) for r in got) == sorted((d or 0, k, t) for d, t, k in rows)


def test_long_texts_pass_the_quality_stage_in_time(spark, tmp_path):
    """A filter on the verdict must not take the hashes of a text into its windows."""
    import time

    words = [f"word{i % 7919}x{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 1), (2, "few words", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = lambda: corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert [r.doc_id for r in stage().collect()] == [1]
    began = time.time()
    stage().collect()
    assert time.time() - began < 10
    plan = stage()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2
