"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""
import gzip
import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuelake.llm import line_dedup, mixing, quality, topk_search, warc
from cuelake.llm.common import stage_path

LONG = "a long line of words\n" * 4000


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", "x") for d, t in rows], "doc_id bigint, text string, n_lines string, kept string")


@pytest.mark.parametrize("batches,fanout", [(1, 4), (3, 2), (7, 2)])
def test_line_dedup(spark, batches, fanout):
    rows = [(3, "Shared line one\nown line of three\nshort"), (1, "x\n \tSHARED line one \n"), (2, None), (4, ""), (9, "own line of three\r\nown line of three"), (None, "shared line one"), (9, "tie with other text\nshared line one"), (9, "tie with other text\nshared line one"), (20, LONG), (21, LONG + "last words here")]
    got = sorted(((r.doc_id is None, r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, rows), batches=batches, fanout=fanout).collect()), key=str)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(low)
    owner = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 10:
                owner[key(x)] = min(owner.get(key(x), d), d)
    want = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if d is None or len(key(x)) < 10 or owner[key(x)] >= d]
        want.append((d is None, d, "\n".join(kept), len(parts), len(parts) - len(kept)))
    assert got == sorted(want, key=str)


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.admit(spark.range(10 * k, 10 * k + 15).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("h"), F.lit(k).cast("bigint").alias("doc_id")))
    assert all(len(level) < 2 for level in runs.levels)
    owners = Counter(r.owner for run in runs.known() for r in run.collect())
    assert owners == {0: 15, 1: 10, 2: 10, 3: 10, 4: 10}
    plan = runs.known()[0].join(spark.range(1).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("h")).hint("merge"), "h")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan  # of the batch only
    runs.drop()


@pytest.mark.parametrize("ids", [[-(2**63), 2**63 - 1, 0], [-(2**63), -(2**63) + 1], [2**63 - 1] * 2, [5, 10**15, 10**18]])
def test_line_dedup_of_extreme_ids(spark, ids):
    table = docs(spark, [(i, f"a common line\nline of {k} alone") for k, i in enumerate(ids)])
    got = {(r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(table).collect()}
    assert got == {(i, int(i != min(ids))) for i in ids}


def test_quality_counts(spark):
    texts = [None, "", " \n", "few words", "w " * 50, " ".join(f"w{i}" for i in range(30)), "a b c d e f g h i j k l " * 3 + "# $ <x>", "same\nsame\n\nsame \nother " + " ".join(f"q{i}" for i in range(20)), LONG]
    rows = list(enumerate(texts)) + [(None, texts[5]), (5, texts[5])]
    trusted = spark.createDataFrame([(5,), (6,)], "doc_id bigint")
    got = quality.quality_rules(docs(spark, rows), trusted).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (not r.kept or not r.base_failed)


def test_mixing_keeps_rows_and_shares(spark):
    counts = {"a": 700, "b": 200, "c": 100, None: 40}
    rows = [(None if s is None and i < 3 else 1000 * k + i, s) for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    rows += [(5, "a"), (5, "a")]
    table = spark.createDataFrame([(d, None if d == 7 else str(d), s, "x") for d, s in rows], "doc_id bigint, text string, source string, slot string")
    weights = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), ("", 1)], "source string, weight int")
    with pytest.raises(ValueError, match="divide them"):
        mixing.mix_sources(table, weights.withColumn("weight", F.col("weight") * 10_000))
    got = mixing.mix_sources(table, weights, block_docs=4).collect()
    assert len(got) == len(rows) and len({(r.source, r.source_rank) for r in got}) == len(rows)
    slots = {}
    for r in got:
        slots[r.slot] = r.source or ""
    share = {"a": 0.5, "b": 0.3, "c": 0.1, "": 0.1}
    seen = Counter()
    for t in range(100):  # every source still has blocks here
        seen[slots[t]] += 1
        assert all(abs(seen[s] - share[s] * (t + 1)) < 1 for s in share)
    empty = mixing.mix_sources(table.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "source", "source_rank", "block", "slot", "pos"]
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == [] and quality.quality_rules(docs(spark, []), spark.range(0).select(F.col("id").alias("doc_id"))).collect() == []


@pytest.mark.parametrize("sources,period", [(1_500, mixing.PERIOD), (300, 16)])
def test_mixing_holds_more_sources_than_the_period(spark, sources, period):
    sizes = {f"s{i}": 1 + 2 * (i % 3) for i in range(sources)} | {"hot": sources}
    rows = [(s, k) for s, n in sizes.items() for k in range(n)]
    table = spark.createDataFrame([(i, s, "x") for i, (s, _) in enumerate(rows)], "doc_id bigint, source string, text string")
    got = mixing.mix_sources(table, block_docs=1, period=period).collect()
    assert len(got) == len(rows) and all(r.slot is not None and r.slot >= 0 for r in got)
    assert len({(r.slot, r.pos) for r in got}) == len(rows)
    assert all(r.slot < q.slot for r, q in zip(*(lambda x: (x, x[1:]))(sorted((r for r in got if r.source == "hot"), key=lambda r: r.source_rank))))
    weights = [r.weight for r in mixing.target_weights(table, period=period).collect()]
    assert len(weights) == len(sizes) and min(weights) >= 1
    # the tempered share of the hot source, in any prefix of the slots
    mass = {s: n**0.5 for s, n in sizes.items()}
    share = mass["hot"] / sum(mass.values())
    hot = sorted(r.slot for r in got if r.source == "hot")
    for n, slot in enumerate(hot[:-1], 1):
        assert abs(n - share * (slot + 1)) <= 3 + 0.2 * share * (slot + 1), (n, slot, share)


def test_top_k_equals_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(300)]
    rows += [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (304, [])]
    rows += [(40, rows[40][1]), (310, rows[3][1]), (311, rows[3][1]), (320, [1e6] * 8)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, rank int")
    ints = topk_search.integer_vectors(table)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk_search.top_k(ints.filter("vec_id % 20 = 0"), ints, 5, block=64, together=8).collect())
    good = {(i, tuple(int(np.floor(64 * x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, qv in good:
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    early = topk_search.top_k(ints.filter("vec_id % 20 = 0"), ints, 5, block=64, together=8).filter("depth < 1").count()
    assert early > 0
    assert topk_search.top_k(ints.limit(0), ints).collect() == []


def test_top_k_of_unequal_lengths(spark):
    rows = [(i, [i % 7, *[i % 5 - 2] * (i % 3)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk_search.top_k(table, table, 3, block=8).collect())
    want = []
    for i, q in rows:
        near = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in rows if j != i and len(x) == len(q))[:3]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(near, 1)]
    assert got == sorted(want)
    with pytest.raises(ValueError):
        topk_search.top_k(table, spark.createDataFrame([(1, [2**62])], "vec_id bigint, vector array<bigint>"))


def test_warc_round_trip(spark):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://a.b/x", big), (3, "http://a.b/y\r\n", big), (9, None, "small"), (8, "", "small"), (1, "http://z", None), (None, "http://n", big), (3, "http://a.b/w", big), (7, "http://l", LONG), (11, "http://l", LONG)]
    pages = spark.createDataFrame([(i, u, h, "c") for i, u, h in rows], "page_id bigint, url string, html string, record_type string")
    path = stage_path(spark, "warc")
    warc.write_warc(pages, path, file_rows=2)
    records = warc.read_warc(spark, path)
    captures = warc.assemble(records)
    assert captures.filter("size(requests) = 1 AND size(metadata) = 1").count() == len(rows)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve_revisits(captures).collect()), key=str)
    kind = {5: ("revisit", 3), 3: ("response", None), 9: ("response", None), 8: ("response", None), 1: ("response", None), None: ("revisit", 3), 7: ("response", None), 11: ("revisit", 7)}
    want, first = [], True
    for i, _, h in rows:
        k = kind[i]
        if i == 3 and not first:
            k = ("revisit", 3)
        first = first and i != 3
        b = (h or "").encode()
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), *k))
    assert got == sorted(want, key=str)
    empty = stage_path(spark, "warc")
    warc.write_warc(pages.limit(0), empty)
    assert warc.resolve_revisits(warc.assemble(warc.read_warc(spark, empty))).collect() == []


def test_warc_negative_and_null_ids(spark):
    big = "x" * 200
    pages = spark.createDataFrame([(-5, None, big), (3, None, big), (None, None, big), (2**63 - 1, None, big), (-(2**63), None, "s")], "page_id bigint, url string, html string")
    path = stage_path(spark, "warc")
    warc.write_warc(pages, path)
    records = warc.read_warc(spark, path)
    assert records.select("record_id").distinct().count() == 15
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.resolve_revisits(warc.assemble(records)).collect()}
    assert got == {(-5, "response", None), (3, "revisit", -5), (None, "revisit", -5), (2**63 - 1, "revisit", -5), (-(2**63), "response", None)}


def test_archives_longer_than_a_read_buffer(spark):
    pages = spark.range(4_000).select(F.col("id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.repeat(F.lit("pay\r\nload\n"), (F.col("id") % 97).cast("int")).alias("html"))
    path = stage_path(spark, "warc")
    warc.write_warc(pages.coalesce(1), path)
    records = warc.read_warc(spark, path)
    assert records.count() == 12_000
    got = {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.resolve_revisits(warc.assemble(records)).collect()}
    payload = lambda i: b"pay\r\nload\n" * (i % 97)
    assert got == {(i, len(payload(i)), hashlib.sha256(payload(i)).hexdigest()) for i in range(4_000)}


@pytest.mark.parametrize("form", ["members", "plain"])
def test_foreign_archives(spark, tmp_path, form):
    blocks = [b"", bytes(range(256)) * 3, b"WARC/1.1\r\n\r\nWARC/1.0\r\n\r\n", b"\r\n\r\nWARC/" * 50, b"\r\n\r\n", b"p" * 100_000]
    raw = [b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(x)) + x + b"\r\n\r\n" for i, x in enumerate(blocks)]
    for k in range(2):
        file = tmp_path / f"{k}.warc{'.gz' if form == 'members' else ''}"
        file.write_bytes(b"".join(map(gzip.compress, raw)) if form == "members" else b"".join(raw))
    got = sorted((r.record_id, bytes(r.block), r.payload_bytes) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert got == sorted((f"<{i}>", x, len(x)) for i, x in enumerate(blocks) for _ in range(2))


def test_hops_between_records(spark):
    row = lambda rid, kind, *to: (rid, kind, None, None, list(to), None, None, None, None, None, None)
    records = spark.createDataFrame([row("r", "response", "q2"), row("q", "request", "r"), row("q2", "request"), row("m", "metadata", "q"), row("lost", "metadata", "nowhere")], warc.RECORDS)
    got = warc.assemble(records).collect()
    assert [(g.capture_id, [x.record_id for x in g.requests], [x.record_id for x in g.metadata]) for g in got] == [("r", ["q", "q2"], ["m"])]
