"""Queries beyond SQL, held against plain Python over every row of the smallest tables."""
import re
from collections import defaultdict
from difflib import SequenceMatcher

import duckdb
import pytest

from cuelake.catalog import QUERIES
from cuelake.functions.similarity import overlap_merge
from cuelake.operators import lexicon as lex
from cuelake.plans.bindings import PAIRS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    return lambda sql: con.execute(re.sub(r"\b(documents|conversations)\b", lambda m: f"'{SF}/{m.group()}.parquet'", sql)).fetchall()


@pytest.fixture(scope="module")
def lines(tables):
    """(doc_id, line_no, line)"""
    return [(d, i, x) for d, t in tables("SELECT doc_id, text FROM documents") if t is not None for i, x in enumerate(t.split("\n"))]


def rows(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect())


def test_x2_similarity(spark, lines):
    want = []
    for (d, i, x), (e, _, y) in zip(lines, lines[1:]):
        if d == e:
            want.append((d, i, SequenceMatcher(None, x.lower(), y.lower()).ratio()))
    assert rows(spark, "x2_similarity", "media_id", "line_no", "ratio") == sorted(want)


def test_x4_overlap_merge(spark, tables):
    said = sorted(tables("SELECT conv_id, turn, text FROM conversations"))
    want = [(c, t, len(overlap_merge(x, y))) for (c, t, x), (k, _, y) in zip(said, said[1:]) if c == k]
    assert rows(spark, "x4_overlap_merge", "conv_id", "turn", "n") == want


@pytest.mark.parametrize("name", ["x12_enforce_words", "x13_proper_names"])
def test_whole_word_rules(spark, lines, name):
    pairs = PAIRS if name == "x12_enforce_words" else sorted(((k, k.capitalize()) for k, _ in PAIRS), key=lambda p: -len(p[0]))
    rules = [(re.compile(rf"(?i)\b{k}\b"), v) for k, v in pairs]
    want = set()
    for _, _, x in lines:
        out = x
        for pattern, v in rules:
            out = pattern.sub(v, out)
        want.add((x, out))
    assert rows(spark, name, "text", "out") == sorted(want)


def test_x15_longest_match(spark, tables, lines):
    known = {w for (t,) in tables("SELECT text FROM documents") if t is not None for w in t.split(" ") if 0 < len(w) <= lex.MAX_KEY and not re.match("[A-Za-z0-9]", w)}
    longest = max(map(len, known))
    copied, alnum = ",.!?()[]{}:;\"'<>~@#$%^&*_-+=/\\|", re.compile("[A-Za-z0-9]+")
    want = set()
    for x in {x for _, _, x in lines}:
        out, at = [], 0
        while at < len(x):
            run = alnum.match(x, at)
            if run:
                part = run.group()
            elif x[at].isspace() or x[at] in copied:
                part = x[at]
            else:
                part = next((x[at : at + n] for n in range(min(longest, len(x) - at), 0, -1) if x[at : at + n] in known), x[at])
            out.append(part.upper() if part in known and not (run or part in copied) else part)
            at += len(part)
        text = re.sub(r"\s+([,.!?])", r"\1", " ".join(out))
        want.add((x, " ".join(text.split())))
    assert rows(spark, "x15_longest_match", "text", "out") == sorted(want)


def test_x18_word_wrap(spark, lines):
    want = []
    for d, i, x in lines:
        made = []
        for w in x.split():
            if made and len(made[-1]) + 1 + len(w) <= 40:
                made[-1] += " " + w
            else:
                made.append(w)
        want += [(d, i, n, row, len(row) > 40) for n, row in enumerate(made)]
    assert rows(spark, "x18_word_wrap", "media_id", "line_no", "n", "row", "overflow") == sorted(want)


def test_x18_fit_text(spark, lines):
    width = lambda x: 500 * (len(x) + sum("一" <= c <= "鿿" or "　" <= c <= "〿" or "＀" <= c <= "￯" for c in x))
    want = []
    for d, i, x in lines:
        for size in range(48, 11, -1):
            made = []
            for w in x.split():
                if made and width(made[-1] + " " + w) <= 900_000 // size:
                    made[-1] += " " + w
                else:
                    made.append(w)
            over = any(width(m) * size > 900_000 for m in made) or len(made) * size * 1.2 > 200
            if not over:
                break
        want.append((d, i, size, len(made), "|".join(made), over))
    got = rows(spark, "x18_fit_text", "media_id", "line_no", "size", "n_lines", "lines", "overflow")
    assert got == sorted(want)


def test_b12_translate_set(spark, tables):
    by_conv = defaultdict(list)
    for c, t, x in sorted(tables("SELECT conv_id, turn, text FROM conversations")):
        by_conv[c].append((t, x))
    squeeze = lambda x: " ".join(x.split())
    phrases = lambda x: x  # no phrase rule applies to these languages
    mark = re.compile(r"\s+([,.!?])")
    segment = re.compile(r"[A-Za-z0-9]+|.", re.S)
    want = []
    for c, turns in by_conv.items():
        for n, (t, x) in enumerate(turns):
            batch, pos = divmod(n, 15)
            if batch % 3 == 2:  # the answer holds a line too many: the dictionary, which has no key for these texts
                want.append((c, t, phrases(squeeze(mark.sub(r"\1", " ".join(segment.findall(x)))))))
            else:
                want.append((c, t, squeeze(f"t{pos}" + x.replace("\n", " "))))
    assert rows(spark, "b12_translate_set", "media_id", "ord", "out") == sorted(want)
