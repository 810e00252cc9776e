"""Script cleaning, sentences, overlap merging and drafts against plain versions written from their definitions."""
import difflib
import json
import re

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as t
from cuelake.functions.similarity import overlap_merged
from cuelake.operators import translate as tr
from cuelake.plans import quality_queries

FOLDER = "/root/testdata/sf0.001"
SCRIPTS = [
    None, "", "\n\n", "Hook: Xin chào các bạn!\nKịch bản: bỏ dòng này\n- Điểm một…  hay lắm\n2) Thứ hai 3.5 kg\nTIÊU ĐỀ LỚN NHẤT\n**Đậm** và `mã` _nghiêng_\nvo: “Lời đọc” – đây\nVoice over:\nOK\nABC12\n(nhạc nền) tiếp tục [cảnh 2] nhé",
    "a" * 400, "One two three. Four five? Six! v.v. 1.5 more… yes", ", ".join(f"clause number {i}" for i in range(60)) + ".", "word " * 120, "x - y - z; " * 40, "…。！？ \" ' .", "Ghi chú kỹ thuật giữa dòng\nthường\r\nkhác\rcuối",
]


def plain_script(x):
    if x is None:
        return None
    x = x.replace("\r\n", "\n").replace("\r", "\n").replace("…", "...")
    for a, b in zip("“”‘’–—", "\"\"''--"):
        x = x.replace(a, b)
    x = re.sub(r"(?m)^\s*(?:[-*+]|[0-9]+[.)])\s+", "", x)
    x = re.sub("[`*_]", "", x)
    out = []
    for line in x.split("\n"):
        line = line.strip()
        low = line.lower()
        for p in t.SPOKEN_PREFIXES:
            if low.startswith(p):
                line = line[len(p) :].strip()
                break
        low = line.lower()
        core = re.sub(r"[^a-zA-ZÀ-Ỹ0-9\s]", "", line).strip()
        shout = len(core) > 5 and core == core.upper() and core != core.lower()
        if line and not shout and not any(low.startswith(p) for p in t.NOTE_PREFIXES) and not any(w in low for w in t.NOTE_WORDS):
            out.append(line)
    x = "\n".join(out)
    for pattern, put in t.INLINE_RULES:
        x = re.sub(pattern.replace("(?U:", "(?:"), re.sub(r"\$(\d)", r"\\\1", put), x)
    return x.strip()


def pack(parts, limit):
    out = []
    for p in parts:
        if out and len(out[-1]) + 1 + len(p) <= limit:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def plain_sentences(x, limit=155):
    x = plain_script(x)
    if x is None:
        return []
    for a in t.ABBREVIATIONS:
        x = re.sub(rf"(?i)\b{a}\.", lambda m: re.sub(r"\\(.)", r"\1", a) + "\ue000", x)
    x = re.sub(r"([0-9])\.([0-9])", "\\1\ue000\\2", x)
    out = []
    for part in re.findall(r'[^.?!…。！？]*[.?!…。！？]+"?|[^.?!…。！？]+', x):
        s = " ".join(part.replace("\ue000", ".").split())
        pieces = [s] if s else []
        if len(s) > limit:
            cut = re.sub(r"\s+-\s+", " -\ue001", re.sub(r"([,;:])\s+", "\\1\ue001", s)).split("\ue001")
            fitted = []
            for c in filter(None, (c.strip(" ") for c in cut)):
                fitted += [c] if len(c) <= limit else pack(c.split(" "), limit)
            pieces = [c.rstrip(" ,;:-") for c in pack(fitted, limit)]
        for p in pieces:
            p = p.strip(" \"'")
            if p:
                p = p if p[-1] in ".?!…。！？" else p + "."
                out.append(p[0].upper() + p[1:])
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()] + SCRIPTS


def test_scripts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    for r in df.select("text", t.clean_script(F.col("text")).alias("x")).collect():
        assert r.x == plain_script(r.text), r.text


def test_sentences(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    for r in df.select("text", t.sentences(F.col("text")).alias("x")).collect():
        assert (r.x or []) == plain_sentences(r.text), r.text


def plain_merge(a, b):
    """Every border is compared, from the largest."""
    a, b = (a or "").strip(), (b or "").strip()
    if not a or not b or a in b or b in a:
        return a if len(a) >= len(b) else b
    words = (a.split(), b.split(), " ", lambda x, y: " ".join(x + y))
    chars = (a, b, "", lambda x, y: x + y)
    for x, y, _, put in (words, chars):
        for n in range(min(len(x), len(y)), 0, -1):
            if x[len(x) - n :] == y[:n]:
                return put(x[: len(x) - n], y) if put is words[3] else x + y[n:]
    for (x, y, join, put), least, over in ((words, 2, 0.80), (chars, 3, 0.85)):
        best, size = over, 0
        for n in range(min(len(x), len(y)), least - 1, -1):
            score = difflib.SequenceMatcher(None, join.join(x[len(x) - n :]).lower(), join.join(y[:n]).lower()).ratio()
            if score > best:
                best, size = score, n
        if size:
            return put(x[: len(x) - size], y) if put is words[3] else x + y[size:]
    return a + ("" if re.search(r"[\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]", a + b) else " ") + b


def test_overlap_merge(spark):
    rows = [("the quick brown fox", "brown fox jumps"), ("the quick brown fax", "brown fox jumps over"), ("你好世界", "世界和平"), ("", "x"), (None, None), ("abc", "abc"), ("hello wor", "world"), ("AbcdefG", "bcdefgh"), ("one two three", "tow three four")]
    long = [r.text[:160] for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("text").limit(24).collect()]
    rows += [(x, x[40:] + " and more") for x in long] + [(x, x[50:90].replace("e", "i") + " end") for x in long] + list(zip(long, long[1:]))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", overlap_merged("a", "b").alias("x")).collect()
    assert [r.x for r in got] == [plain_merge(r.a, r.b) for r in got]


def test_overlap_query_merges_each_turn_with_the_next(spark):
    got = {(r.conv_id, r.turn): r.merged for r in quality_queries.x4(spark, FOLDER).collect()}
    by = {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.text))
    pairs = {(c, x[0]): (x[1], y[1]) for c, v in by.items() for x, y in zip(sorted(v), sorted(v)[1:])}
    assert set(got) == set(pairs)
    assert all(got[k] == plain_merge(*pairs[k]) for k in sorted(pairs, key=lambda k: sum(map(len, pairs[k])))[:25])


def test_draft_and_refine(spark):
    """Remembered text, else the answer by id, else the line itself if its batch was answered, else the draft."""
    cues = [(m, o, f"cau {m} {o} 你" if o % 3 else "nhớ rồi", "a", "b", "e") for m in (1, 2, 3) for o in range(30)]
    memory = [("a", "b", "e", "nhớ rồi", "từ bộ nhớ"), ("a", "b", "other", "cau 1 1 你", "never")]
    answers = {(1, 0): [{"id": 1, "text": "đáp 0"}, {"id": 5, "text": "đáp 5"}], (1, 1): None, (2, 1): [{"id": 3, "text": "đáp 3"}]}
    raw = [(m, b, 12, "not json" if v is None else "```json\n" + json.dumps(v, ensure_ascii=False) + "\n```") for (m, b), v in answers.items()]
    want = {}
    for m in (1, 2, 3):
        open_lines = [c for c in cues if c[0] == m and c[2] != "nhớ rồi"]
        for i, c in enumerate(open_lines):
            batch, pos = divmod(i, 12)
            found = answers.get((m, batch))
            named = {x["id"] - 1: x["text"] for x in found or []}  # ids are from 1
            want[m, c[1]] = named.get(pos, c[2] if found else c[2].replace("你", "bạn"))
    want |= {(c[0], c[1]): "từ bộ nhớ" for c in cues if c[2] == "nhớ rồi"}
    df = spark.createDataFrame(cues, "media_id bigint, ord bigint, text string, src string, tgt string, engine string")
    mem = spark.createDataFrame(memory, "src string, tgt string, engine string, text string, value string")
    lexicon = spark.createDataFrame([("你", "bạn"), ("好", "tốt")], "key string, value string")
    refined = spark.createDataFrame(raw, "media_id bigint, batch bigint, n int, raw string")
    got = {(r.media_id, r.ord): r.out for r in tr.draft_and_refine(df, mem, lexicon, refined).collect()}
    norm = lambda x: re.sub(r"\s+", " ", x)
    assert {k: norm(v) for k, v in got.items()} == {k: norm(v) for k, v in want.items()}
