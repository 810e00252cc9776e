"""Literal cases of the operators and twin tests of the folds."""
import random

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as t
from cuelake.functions import time as tm
from cuelake.functions.similarity import alike, overlap_merge
from cuelake.operators import cues as c
from cuelake.operators import detections as det
from cuelake.operators import folds, lexicon, quality, translate
from cuelake.sources import subtitles as s

CUE = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, text string"


def cues(spark, *rows):
    return spark.createDataFrame([(1, i, int(a * 1000), int(b * 1000), x) for i, (a, b, x) in enumerate(rows)], CUE)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_time_formats(spark):
    assert one(spark, tm.parse_timecode(F.lit("00:00:01,5"))) == 1500
    assert one(spark, tm.parse_timecode(F.lit("1:02:03.045"))) == 3_723_045
    assert one(spark, tm.srt_time(F.lit(60_000))) == "00:01:00,000"
    assert one(spark, tm.srt_time(F.lit(-5))) == "00:00:00,000"
    assert one(spark, tm.ass_time(F.lit(61_234))) == "0:01:01.23"
    assert one(spark, tm.srt_time_clamped(F.lit(1.9996))) == "00:00:01,999"


def test_islands(spark):
    got = c.merge_islands(cues(spark, (0, 1, "a"), (1.05, 2, "bbbb"), (5, 6, "c"))).orderBy("start_ms")
    assert [(r.text, r.start_ms, r.end_ms) for r in got.collect()] == [("bbbb", 0, 2000), ("c", 5000, 6000)]


def test_short_noise_and_layout(spark):
    rows = cues(spark, (0, 1, "."), (1, 2, "a"), (2, 3, "Xin chào các bạn"), (3, 4, "好"))
    assert [r.text for r in c.drop_short_noise(rows).orderBy("ord").collect()] == ["Xin chào các bạn", "好"]
    laid = c.lay_out(spark.createDataFrame([(1, 0, "x", 1250), (1, 1, "y", 0)], "media_id bigint, ord bigint, text string, dur_ms bigint")).orderBy("ord").collect()
    assert [(r.start_ms, r.end_ms) for r in laid] == [(0, 1250), (1600, 4100)]


@pytest.mark.parametrize("ms,overlap,plan", [(41_000, 1_500, [(0, 21_500), (20_000, 21_000), (40_000, 1_000)]), (40_500, 0, [(0, 20_000), (20_000, 20_500)]), (500, 0, [(0, 500)])])
def test_chunk_plan(spark, ms, overlap, plan):
    m = spark.createDataFrame([(1, ms)], "media_id bigint, duration_ms bigint")
    assert [(r.start_ms, r.dur_ms) for r in c.chunk_plan(m, overlap_ms=overlap).orderBy("chunk_idx").collect()] == plan


def test_speech_fit_chain(spark):
    rows = cues(spark, (0, 1, "a"), (0, 1, "b"), (0, 1, "c"), (0, 1, "d"))
    clips = spark.createDataFrame([(1, 0, 3000), (1, 1, 5000), (1, 2, 1020), (1, 3, 4000)], "media_id bigint, ord bigint, clip_ms bigint")
    assert [list(r.chain) for r in c.speech_fit(rows, clips).orderBy("ord").collect()] == [[2.0, 1.5], [2.0, 2.0, 1.25], [], [2.0, 2.0]]


def test_edits(spark):
    rows = cues(spark, (1, 4, "a"), (4.5, 8, "b"))
    edit = lambda *e: spark.createDataFrame([e], "media_id bigint, ord bigint, action string, start_ms bigint, end_ms bigint")
    merged = c.apply_edits(rows, edit(1, 0, "merge", 0, 0)).collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in merged] == [(1000, 8000, "a b")]
    split = c.apply_edits(cues(spark, (1, 8, "a b")), edit(1, 0, "split", 0, 0)).orderBy("part").collect()
    assert [(r.start_ms, r.end_ms) for r in split] == [(1000, 4500), (4500, 8000)]


def test_overlap_dedupe_cases(spark):
    two = folds.dedupe_overlap(cues(spark, (0, 2.5, "你好世界"), (2.6, 4, "测试字幕")))
    assert two.count() == 2
    same = folds.dedupe_overlap(cues(spark, (0, 2, "欢迎观看本期视频"), (1.5, 3.5, "欢迎观看本期视频"))).collect()
    assert [(r.start_ms, r.end_ms) for r in same] == [(0, 3500)]


def whole_fold(rows, overlap=1500):
    """The plain fold over all cues of a medium, without islands."""
    out = []
    for r in sorted((r for r in rows if len(r[4].strip()) >= 2), key=lambda r: (r[2], r[1])):
        cue = folds.Cue(r[1], r[2], r[3], r[4])
        if out and folds.joins_overlap(out[-1], cue, overlap, 0.8):
            out[-1] = out[-1].grown(cue, folds.longer(out[-1].text, cue.text))
        else:
            out.append(cue)
    return [(x.ord, x.start, x.end, x.text) for x in out]


def test_islands_do_not_change_the_fold(spark):
    r = random.Random(4)
    words = ["hello world", "hello there world", "good bye", "good by", "[Chữ khó 1]", "x", "ab"]
    rows = [(m, i, s0 := r.randrange(0, 60_000), s0 + r.randrange(-50, 6_000), r.choice(words)) for m in range(5) for i in range(60)]
    got = folds.dedupe_overlap(spark.createDataFrame(rows, CUE)).collect()
    for m in range(5):
        assert sorted((x.ord, x.start_ms, x.end_ms, x.text) for x in got if x.media_id == m) == sorted(whole_fold([x for x in rows if x[0] == m]))


def whole_sampling(rows, hold, miss, oldest):
    out, live, seen = [], False, 0
    for _, o, at, text, stop in sorted(rows, key=lambda r: (r[2], r[1])):
        end = min(at + hold, stop)
        recent = live and at - seen <= miss and at - out[-1][1] < oldest
        if not text:
            live = recent
            if live:
                out[-1][2] = end
        else:
            if recent and "Gemini" not in text and alike(out[-1][3], text):
                out[-1][2] = end
                out[-1][3] = max(out[-1][3], text, key=lambda x: len(" ".join(x.split())))
            else:
                out.append([o, at, end, text])
            live, seen = True, at
    return sorted(map(tuple, out))


def test_sampled_cues_equal_the_plain_machine(spark):
    r = random.Random(9)
    rows = [(1, i, 400 * i + r.randrange(300), r.choice(["", "", "same text", "same text!", "other", "[Gemini] x"]), 100_000) for i in range(300)]
    frame = spark.createDataFrame(rows, "media_id bigint, ord bigint, t_ms bigint, text string, duration_ms bigint")
    want = whole_sampling(rows, 1500, 1200, 8000)
    got = folds.sampled_cues(frame, brief=True)
    assert sorted((x.ord, x.start_ms, x.end_ms, x.text) for x in got.collect()) == want
    lasting = [x for x in want if x[2] - x[1] >= (180 if len(x[3].strip()) >= 4 else 300)]
    assert len(lasting) < len(want)
    assert sorted((x.ord, x.start_ms, x.end_ms, x.text) for x in folds.sampled_cues(frame).collect()) == lasting


def test_sampled_cues_join_boxes(spark):
    rows = [(1, 0, 0, "one line", 9_000, 10, 10, 5, 5), (1, 1, 500, "one line.", 9_000, 12, 2, 9, 9), (1, 2, 900, "", 9_000, 0, 0, 1, 1), (1, 3, 1_000, "one line", 9_000, None, None, None, None)]
    frame = spark.createDataFrame(rows, "media_id bigint, ord bigint, t_ms bigint, text string, duration_ms bigint, x int, y int, w int, h int")
    assert [tuple(r) for r in folds.sampled_cues(frame).collect()] == [(1, 0, 0, 2_500, "one line.", 10, 2, 11, 13)]


def test_terms_in_one_shard_and_in_many(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcabc ab"), (2, ""), (3, None), (4, "zzz"), (4, "ab")], "id bigint, text string")
    terms = spark.createDataFrame([("ab",), ("abc",), ("q",), ("",), ("ab",)], "term string")
    few = sorted(tuple(r) for r in lexicon.find_terms(texts, terms).collect())
    monkeypatch.setattr(lexicon.trie, "SHARD", 1)
    assert few == sorted(tuple(r) for r in lexicon.find_terms(texts, terms).collect()) == [(1, "ab", 3), (1, "abc", 2), (4, "ab", 1)]


@pytest.mark.parametrize("a,b,out", [("", "x", "x"), ("abc def", "def ghi", "abc def ghi"), ("你好世", "世界", "你好世界"), ("one", "two", "one two"), ("中", "文", "中文"), ("long text", "text", "long text"), ("see the hậu kì", "the hậu kỉ now", "see the hậu kỉ now")])
def test_overlap_merge(a, b, out):
    assert overlap_merge(a, b) == out


def test_text_rules(spark):
    x = one(spark, t.spoken_style(F.lit("Bởi vì điều này, tôi muốn nói tóm lại là thành ra là do đó nên làm vậy .")))
    assert x.startswith("Thế nên là") and "tóm lại là" in x and not x.endswith(" .")
    assert one(spark, t.clean_cjk_spaces(F.lit("你 好 世 界 , ok"))) == "你好世界, ok"
    assert one(spark, t.clean_text(F.lit("  A\u3000b\u00a0 C "))) == "a b c"
    script = "Hook: Xin chào các bạn\n[Nhạc nền nhẹ]\n00:00 - 00:03\n(zoom vào) Giá là 3.5 triệu, theo Dr. Nam nói vậy nhé các bạn ơi đây là một câu rất dài, rất dài và còn dài hơn nữa.\nVISUAL: cảnh\nTIÊU ĐỀ LỚN"
    got = one(spark, t.sentences(F.lit(script), 90))
    joined = " ".join(got)
    assert all(len(x) <= 95 for x in got) and "Hook" not in joined and "zoom" not in joined and "00:0" not in joined and "3. 5 triệu" in joined and "Dr." in joined and "LỚN" not in joined


def test_wrap_words(spark):
    assert one(spark, t.wrap_words(F.lit("aa bb cc\n\nabcdefgh i"), 5)) == ["aa bb", "cc", "abcdefgh", "i"]


def test_detections(spark):
    rows = spark.createDataFrame([(1, '[{"original_text":"a","translated_text":"b","box_2d":[500,100,600,300]}]', 640, 360), (2, "broken", 1, 1)], "frame bigint, json string, width int, height int")
    assert [tuple(r.bbox) for r in det.vision_items(rows).collect()] == [(64, 180, 128, 36)]
    boxes = spark.createDataFrame([(1, (10, 20, 100, 30)), (1, (50, 10, 100, 30)), (1, None)], "frame int, box struct<x:int,y:int,w:int,h:int>")
    assert tuple(boxes.agg(det.box_union(F.col("box")).alias("b")).first().b) == (10, 10, 140, 40)
    lines = spark.createDataFrame([(1, 0, 50, 0, 10, 10), (1, 1, 0, 4, 10, 10), (1, 2, 0, 30, 10, 10)], "frame int, ord int, x int, y int, w int, h int")
    assert [(r.ord, r.line) for r in det.reading_order(lines).orderBy("nth").collect()] == [(1, 1), (0, 1), (2, 2)]


def test_lexicon(spark):
    lex = spark.createDataFrame([("你好", "xin chào"), ("你", "bạn")], "key string, value string")
    x = spark.createDataFrame([("你好 abc",), ("你，x1",), (None,)], "text string")
    assert {r.text: r.out for r in lexicon.translate_longest(x, lex).collect()} == {"你好 abc": "xin chào abc", "你，x1": "bạn ， x1", None: None}
    have = spark.createDataFrame([("自定义词", "mine", "c", "Custom"), ("b", "old", "c", "Auto")], "zh string, vi string, category string, source string")
    new = spark.createDataFrame([("自定义词", "other", "n", "Web"), ("b", "new", "n", "Web")], "zh string, vi string, category string, source string")
    assert {r.zh: r.vi for r in lexicon.merge_slang(have, new).collect()} == {"自定义词": "mine", "b": "new"}
    said = spark.createDataFrame([(1, "这个视频让我彻底破防了，真的是绝绝子！")], "id int, text string")
    assert {r.term for r in lexicon.find_terms(said, lexicon.slang_table(spark)).collect()} == {"破防", "绝绝子"}
    pairs = spark.createDataFrame([(0, "显眼包", "thánh tấu hề")], "ord int, key string, value string")
    assert lexicon.replace_longest(spark.createDataFrame([("这个主角是个显眼包",)], "text string"), pairs).first().out.endswith("thánh tấu hề")


def test_batches_and_delays(spark):
    lines = spark.createDataFrame([(1, 0, "x" * 1500), (1, 1, "x" * 900), (1, 2, "x" * 200)], "media_id bigint, ord bigint, text string")
    assert [r.batch for r in translate.budget_batches(lines).orderBy("ord").collect()] == [0, 0, 1]
    for message, want in (("Please retry in 17.818800071s.", 17.818800071), ("'retryDelay': '1s'", 2.0), ("none", 15.0)):
        assert one(spark, quality.retry_delay(F.lit(message))) == want
    answers = spark.createDataFrame([(1, 0, 2, "```\n1\n2\n```"), (1, 1, 2, "one line"), (1, 2, 2, "a|||b")], "media_id bigint, batch bigint, n int, raw string")
    assert sorted((r.batch, r.pos, r.text) for r in translate.align_answers(answers).collect()) == [(0, 0, "1"), (0, 1, "2"), (2, 0, "a"), (2, 1, "b")]


def test_srt_files_round_trip(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("\ufeff1\r\n00:00:01,5 --> 00:00:02,000\r\nline é\r\n  two \r\n\r\nignored\r\n2\r\n00:00:03.000 --> 00:00:04,000\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nx\r\n4\r\n00:00:07,000 --> 00:00:08,000\r\ny".encode())
    (tmp_path / "b.srt").write_bytes("1\n00:00:00,000 --> 00:00:01,000\nd\xe9j\xe0".encode("latin-1"))
    docs = s.read_documents(spark, str(tmp_path)).withColumn("media_id", F.regexp_extract("path", r"([^/]+)\.srt", 1))
    got = {(r.media_id, r.ord): (r.start_ms, r.end_ms, r.text) for r in s.parse_srt(docs).collect()}
    assert got == {("a", 1): (1500, 2000, "line é two"), ("a", 2): (3000, 4000, ""), ("a", 3): (5000, 6000, "x"), ("a", 4): (7000, 8000, "y"), ("b", 1): (0, 1000, "déjà")}
    assert s.parse_srt(docs, keep_empty=False).count() == 4


def test_ass_document(spark):
    preset = spark.createDataFrame([(1, "my/Font.ttf", 32, [255, 255, 0], [0, 0, 0], [0, 0, 0], 2, 0, False, False, 8.0, 5.0, "percent", "center", "bottom", None, None, 1920, 1080)],
        "media_id bigint, font_name string, font_size int, font_color array<int>, outline_color array<int>, bg_color array<int>, outline_width int, bg_opacity int, use_bg_box boolean, smart_pos boolean, margin_v double, margin_h double, margin_type string, h_align string, v_align string, custom_x double, custom_y double, width int, height int")
    doc = s.to_ass(cues(spark, (0, 1, "a\nb"), (1, 2, "[Lỗi]"), (2, 3, "c")), preset).first().document
    assert doc.count("Dialogue:") == 2 and "Font,48,&H0000FFFF" in doc and "a\\Nb" in doc


def test_urls_and_paths(spark):
    rows = spark.createDataFrame([("not-a-url",), (" https://a.b/c ",), ("ftp://x.y",), (None,)], "url string")
    assert [r.accepted for r in s.admit_urls(rows).collect()] == [False, True, False, False]
    for path, ok in (("C:/videos/simple_test.mp4", True), ("C:/videos/中文视频.mp4", False), ("C:/videos/Tiếng Việt.mp4", False)):
        assert one(spark, s.is_ascii(F.lit(path))) is ok
    lists = spark.createDataFrame([(1, '[{"id":1}]'), (2, '{"id":1}'), (3, None), (4, "[broken")], "k int, json string")
    assert [(r.k, r.id) for r in s.json_list(lists, "id int").collect() if r.id is not None] == [(1, 1)]


def test_history_and_search(spark):
    rows = spark.range(55).select(F.lit("u").alias("user"), F.col("id").alias("at"))
    assert quality.keep_latest(rows, "user", [F.desc("at")]).count() == 50
    found = c.search(cues(spark, (0, 1, "Xin chào"), (1, 2, "chào"), (2, 3, "CHÀO")).withColumn("orig", F.lit("z")), "chào", ["text", "orig"]).first()
    assert (found.hits_text, found.hits_orig, found.hits_all) == (3, 0, 3)


def test_longest_match_in_one_shard_and_in_many(spark, monkeypatch):
    entries = {"你好": "xin chào", "你": "bạn", "好吗": "ổn không", "éa": "Éa", "abc": "never"}
    lex = spark.createDataFrame(list(entries.items()), "key string, value string")
    x = spark.createDataFrame([("你好吗 abc",), ("你，x1",), ("plain",), ("",), (None,), ("你好你好éa",)], "text string")
    rows = lambda: {r.text: r.out for r in lexicon.translate_longest(x, lex).collect()}
    one = rows()
    monkeypatch.setattr(lexicon.trie, "SHARD", 2)
    assert rows() == one and len(one) == 6 and one["你，x1"] == "bạn ， x1"


def test_longest_match_query_knows_rare_words(spark, tmp_path, monkeypatch):
    from cuelake.plans import lexicon_queries as q

    spark.createDataFrame([(1, "once éa here"), (2, "plain words")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(q, "distinct_lines", lambda s, d: s.createDataFrame([("x éa y",)], "text string"))
    assert [r.out for r in q.x15(spark, str(tmp_path)).collect()] == ["x ÉA y"]
