"""Steps whose cost grew too fast: same results, without the costly way."""
import random
from difflib import SequenceMatcher

from cuelake.functions import similarity


def test_ratio_without_a_search_a_block(monkeypatch):
    r, texts = random.Random(7), []
    for alphabet in ("ab", "etaoin shrdlu,.XYZ", "".join(map(chr, range(0x4E00, 0x4E60)))):
        texts += ["".join(r.choice(alphabet) for _ in range(n)) for n in (0, 1, 7, 60, 199, 200, 420)]
    texts += [t[: len(t) // 2] + "…" + t[len(t) // 2 :] + t[:9] for t in texts]
    want = {(a, b): SequenceMatcher(None, a, b).ratio() for a in texts for b in texts}
    monkeypatch.setattr(similarity, "SequenceMatcher", None)
    assert {p: similarity.ratio(*p) for p in want} == want


def test_fit_text_packs_lines_not_words(spark):
    from pyspark.sql import functions as F

    from cuelake.functions.text import fit_text

    # one word more costs the same few steps: the sizes tried do not fold over all words
    texts = [(0, None), (1, ""), (2, "a"), (3, "a" * 151), (4, " ".join(["ab", "宽度", "cde，"] * 9)), (5, "word " * 200_000)]
    f = fit_text(F.col("text"), 900, 200, 48, 12)
    made = spark.createDataFrame(texts, "n int, text string").select("n", f.alias("f"))
    assert "aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.n: r.f for r in made.collect()}
    assert got[0].lines is None and got[0].overflow is None
    assert (got[1].size, got[1].lines, got[1].overflow) == (48, [], False)
    assert (got[2].size, got[2].lines, got[2].overflow) == (48, ["a"], False)
    assert (got[3].size, got[3].lines, got[3].overflow) == (12, ["a" * 151], True)
    assert " ".join(got[4].lines) == texts[4][1] and not got[4].overflow
    assert got[5].size == 12 and got[5].overflow and {len(x) for x in got[5].lines[:-1]} == {149}


def test_script_lines_go_through_each_pattern_once(spark):
    from pyspark.sql import functions as F

    from cuelake.functions.text import NO_LETTER, clean_script, sentences

    x = "Hook: Hello  there　\n\n# KỊCH BẢN BIG\nGhi chú: no\n- Dr. Ana lives in TP. Hà Nội , ok\r\nVO:  3.5 v.v. (note) fin\n SHOUTED LINE "
    made = spark.createDataFrame([(x,)], "text string").select(clean_script(F.col("text")).alias("c"), sentences(F.col("text")).alias("s"))
    assert spark.createDataFrame([(x,)], "text string").select(clean_script(F.col("text")))._jdf.queryExecution().analyzed().toString().count(NO_LETTER) <= 2
    row = made.head()
    assert row.c == "Hello there\nDr. Ana lives in TP. Hà Nội, ok\n3. 5 v. v. fin"
    assert row.s == ["Hello there Dr. Ana lives in TP. Hà Nội, ok 3.", "5 v.", "V.", "Fin."]


def test_word_rules_are_patterns_of_the_plan(spark):
    from cuelake.operators import lexicon as lex

    texts = spark.createDataFrame([("The on, once ON é.",), (None,)], "text string")
    pairs = spark.createDataFrame([(1, "on", "$1\\"), (0, "the", "on")], "ord int, key string, value string")
    plan = lex.enforce_words(texts, pairs)
    assert "lambda" not in plan._jdf.queryExecution().optimizedPlan().toString()
    many = pairs.unionByName(spark.range(2, 300).selectExpr("CAST(id AS INT) AS ord", "concat('zz', id) AS key", "'' AS value"))
    for out in (plan, lex.enforce_words(texts, many)):
        assert {r.text: r.out for r in out.collect()} == {"The on, once ON é.": "$1\\ $1\\, once $1\\ é.", None: None}
    gap = lex.enforce_words(texts, spark.createDataFrame([(0, "a", None)], "ord int, key string, value string"))
    assert [r.out for r in gap.collect()] == [None, None]


def test_long_texts_are_walked_in_slices(spark, monkeypatch):
    from cuelake.operators import lexicon as lex
    from cuelake.operators import trie

    monkeypatch.setattr(trie, "SLICE", 100)
    assert list(trie.slices([30, 80, 20, 500, 0, 1])) == [(0, 1), (1, 3), (3, 4), (4, 6)] and list(trie.slices([])) == []
    monkeypatch.undo()
    texts = [(i, f"破防 {i} " * n) for i, n in enumerate([200_000, 0, 3, 250_000, 1])] + [(9, None)]
    found = lex.find_terms(spark.createDataFrame(texts, "id bigint, text string").coalesce(1), lex.slang_table(spark))
    assert sorted((r.id, r.term, r.n) for r in found.collect()) == [(0, "破防", 200_000), (2, "破防", 3), (3, "破防", 250_000), (4, "破防", 1)]


def test_masked_timeline_adds_up_where_it_reads(spark):
    from cuelake.operators.cues import masked_timeline

    texts = [(m, o, "ab**" * (m * 4_000 + o) + " .") for m in range(3) for o in range(3)] + [(5, 0, None), (5, 1, ""), (5, 2, "*a,*")]
    made = masked_timeline(spark.createDataFrame(texts, "media_id bigint, ord int, text string").repartition(2))
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in made.collect():
        got.setdefault((r.media_id, r.ord), []).append((r.part, r.kind, r.start_ms, r.dur_ms))
    for m, o, text in texts[:9]:
        want, at = [], 0
        for kind, ms in [("speech", 300), ("tone", 400)] * (m * 4_000 + o) + [("silence", 100)]:
            want.append((len(want), kind, at, ms))
            at += ms
        assert sorted(got.pop((m, o))) == want
    assert {k: sorted(v) for k, v in got.items()} == {(5, 2): [(0, "tone", 0, 400), (1, "speech", 400, 300), (2, "tone", 700, 400)]}


def test_borders_are_not_cut_out_one_by_one():
    class Counting(list):
        cuts = 0

        def __getitem__(self, at):
            Counting.cuts += isinstance(at, slice)
            return super().__getitem__(at)

    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(6))
    a, b = Counting(word() for _ in range(400)), [word() for _ in range(400)]
    assert similarity.closest_border(a, b, " ", 2, 0.80) == 0 and Counting.cuts < 60
    tail = ["Σίσυφος", "İki", "x"]
    assert similarity.closest_border([*a, *tail], ["ΣΊΣΥΦΟΣ", "iki", "x", *b], " ", 2, 0.80) == 3
    assert [similarity.exact_border(*p) for p in (("abcab", "abx"), ("aaa", "aaaa"), ("abc", "xyz"), ("", "a"), ("ab", "b"))] == [2, 3, 0, 0, 1]


def test_a_medium_is_one_row_of_the_state(spark, tmp_path):
    from pyspark.sql import functions as F

    from cuelake.streaming import cues as st

    kind = "media_id bigint, ord bigint, text string"
    rows = [(m, o, None if o % 3 else f"{m} {o}") for o in range(40) for m in (*range(25), None)]
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/in")
    made = st.packed(spark.read.parquet(f"{tmp_path}/in")).collect()
    assert len(made) == 26 and sorted(((r.media_id is None, r.media_id), o, t or "") for r in made for o, t in zip(r.ord, r.text)) == sorted(((m is None, m), o, t or "") for m, o, t in rows)
    # no frame is built for a medium
    cues = st.read_stream(spark, f"{tmp_path}/in", kind).selectExpr("media_id", "ord", "900 * ord AS start_ms", "900 * ord + 700 AS end_ms", "text", "900 * ord AS t_ms", "bigint(99000) AS duration_ms").withColumn("ts", F.timestamp_millis("start_ms"))
    for stream in (st.dedupe_stream(cues), st.sample_stream(cues), st.mark_behind(cues, "30 seconds"), st.mark_late(cues.drop("ts"), 30_000)):
        plan = stream._jdf.queryExecution().analyzed().toString()
        assert "TransformWithStateInPySpark" in plan and "MapInArrow" in plan


def test_rows_without_a_time_are_not_late(spark, tmp_path):
    from cuelake.streaming import cues as st

    kind = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, text string, ts timestamp"
    for k in range(2):
        spark.sql(f"SELECT 1L, {k}L, 0L, 1L, 'a', CAST(NULL AS TIMESTAMP) UNION ALL SELECT 1L, {k + 2}L, 0L, 1L, 'b', TIMESTAMP '2024-01-0{3 - k} 00:00:00'").toDF(*[c.split()[0] for c in kind.split(", ")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        st.split_rows(st.mark_behind(st.read_stream(spark, f"{tmp_path}/in", kind), "30 seconds"), f"{tmp_path}/on", f"{tmp_path}/late", f"{tmp_path}/cp")
    got = [sorted((r.ord, r.behind_ms) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()) for name in ("on", "late")]
    assert got == [[(0, 0), (1, 0), (2, 0)], [(3, 86_400_000)]]


def test_arrivals_are_not_dealt_out_by_one_task(spark, tmp_path, monkeypatch):
    from cuelake.plans import streaming_queries as sq

    e = spark.range(400).selectExpr("id AS event_id", "CAST(timestamp_millis(1704067200000 + id * 3600000) AS TIMESTAMP_NTZ) AS ts", "id % 9 AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    e.repartition(4).write.parquet(f"{tmp_path}/d/events.parquet")
    monkeypatch.setattr(sq, "place", lambda spark: f"{tmp_path}/at")
    got = {(r.media_id, r.ord): (r.late, r.behind_ms) for r in sq.r5b(spark, f"{tmp_path}/d").collect()}
    assert len(list((tmp_path / "at" / "in").glob("*.parquet"))) > sq.ARRIVALS + 2
    file = lambda i: i * sq.ARRIVALS // 400 + (2 if i % 7 == 3 else 0)
    for i in range(400):
        before = [k for k in range(400) if file(k) < file(i)]
        own = [k for k in before if k % 9 == i % 9]
        assert got.pop((i % 9, i)) == (bool(before) and i <= max(before) - 24, 3_600_000 * max([k - i for k in own] + [0]))
    assert not got


def test_similar_cues_are_folded_by_medium_not_by_run(spark, monkeypatch):
    from cuelake.operators import folds

    asked, in_pieces = [], folds.in_pieces
    monkeypatch.setattr(folds, "in_pieces", lambda rows, keys, *more, **kw: asked.append(keys) or in_pieces(rows, keys, *more, **kw))
    texts = ["a line of text", "", "a line of text", "a line of text!", None, None, "a line of text", "other"]
    rows = [(m, 10 * i, i, texts[(i + m) % 8]) for m in range(3) for i in range(21)] + [(7, 0, 0, ""), (7, 1, 1, None)]
    frames = spark.createDataFrame(rows, "media_id bigint, t_ms int, ord int, text string")
    want, cue = [], None
    for m, t, o, text in rows:
        if cue and cue[0] == m and text and cue[4] and folds.alike(cue[4], text):
            cue[3], cue[4] = t + 1_500, folds.longer(cue[4], text)
        else:
            cue = [m, o, t, t + 1_500, text] if text else None
            want += [cue] if cue else []
    for bits in (2, 13):
        assert sorted(map(list, folds.consecutive_similar(frames, piece_bits=bits).collect())) == sorted(want)
    assert asked == [["media_id"]] * 2
