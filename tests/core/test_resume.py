"""Folds in pieces against the plain folds."""
import random

import pyarrow as pa
import pytest

from cuelake.operators import detections as det
from cuelake.operators import translate as tr
from cuelake.operators import folds, quality
from cuelake.operators.resume import folded, numbered


def plain_batches(lines, budget):
    out, state = [], {}
    for m, o, text in sorted(lines, key=lambda r: (r[0], r[1])):
        n = len(text or "")
        batch, chars = state.get(m, (0, 0))
        if chars + n > budget and chars > 0:
            batch, chars = batch + 1, 0
        state[m] = (batch, chars + n)
        out.append((m, o, batch))
    return sorted(out)


@pytest.mark.parametrize("bits", [3, 5, 13])
def test_budget_batches(spark, bits):
    r = random.Random(bits)
    lines = [(1, o, "x" * r.choice([0, 1, 3, 30, 80])) for o in range(600)] + [(m, -o, None if o % 5 == 0 else "y" * (o % 7)) for m in range(2, 60) for o in range(r.randrange(1, 6))]
    lines += [(99, o, "") for o in range(100)] + [(100, o, "z") for o in range(300)]  # never over the budget: no piece forgets its past
    df = spark.createDataFrame([(*x, "extra", 7) for x in lines], "media_id bigint, ord bigint, text string, batch string, local int").repartition(4)
    got = sorted(tuple(x) for x in tr.budget_batches(df, 100, piece_bits=bits).collect())
    assert got == plain_batches(lines, 100)
    assert tr.budget_batches(df.limit(0), 100).collect() == []


def plain_reuse(rows, change, flat):
    out, kept = [], {}
    for key, o, x in sorted(rows, key=lambda r: (r[0], r[1])):
        last = kept.get(key)
        if x is not None and last and last[1] is not None and len(last[1]) == len(x) and x and sum(abs(a - b) for a, b in zip(last[1], x)) / len(x) < change:
            out.append((*key, o, "reuse", last[0]))
        elif flat is not None and x and (sum((a - sum(x) / len(x)) ** 2 for a in x) / len(x)) ** 0.5 < flat:
            out.append((*key, o, "empty", -1))
        else:
            kept[key] = (o, x)
            out.append((*key, o, "read", o))
    return sorted(out)


@pytest.mark.parametrize("bits", [3, 13])
@pytest.mark.parametrize("flat", [None, 2.0])
def test_change_reuse(spark, bits, flat):
    """Slow drifts, in which where a piece begins decides what is kept, still and flat runs, a hot medium."""
    r = random.Random(7)
    rows, at = [], [50.0] * 4
    for o in range(400):
        at = [v + r.choice([0, 0, 1, 2, -1, 8]) for v in at]
        rows.append(((1, "blur"), o, list(at) if o % 9 else [at[0]] * 4))
    rows += [((m, mode), o, [float(r.randrange(12)) for _ in range(4)]) for m in (2, 3) for mode in ("blur", "black") for o in range(7)]
    rows += [((4, "black"), 0, None), ((4, "black"), 1, [1.0, 9.0]), ((4, "black"), 2, [1.0, 9.0, 3.0]), ((4, "black"), 3, []), ((4, "black"), 4, [1.0, 9.0, 3.0])]
    df = spark.createDataFrame([(*k, o, x, "extra") for k, o, x in rows], "media_id bigint, mode string, ord bigint, feat array<float>, action string").repartition(3)
    got = det.change_reuse(df, keys=("media_id", "mode"), change=5.5, flat=flat, piece_bits=bits)
    assert sorted((*x[:4], -1 if x[4] is None else x[4]) for x in map(tuple, got.collect())) == plain_reuse(rows, 5.5, flat)


def test_a_fold_that_never_forgets_is_still_exact(spark):
    """A running sum carries its state through every piece."""

    def fold(table: pa.Table, state):
        total, out = int(state or 0), []
        for v in table["v"].to_pylist():
            total += v
            out.append(total)
        return pa.table({"k": table["k"], "v": table["v"], "total": out}), str(total).encode()

    rows = [(k, v) for k in ("a", None) for v in range(64)]
    got = folded(spark.createDataFrame(rows, "k string, v bigint"), ["k"], ["v"], fold, "k string, v bigint, total bigint", piece_bits=4).collect()
    assert sorted((r.k or "", r.total) for r in got) == sorted((k or "", v * (v + 1) // 2) for k, v in rows)


@pytest.mark.parametrize("bits", [2, 13])
def test_numbers_of_rows(spark, bits):
    r = random.Random(1)
    rows = [(k, r.random(), "x") for k in ["hot"] * 300 + ["a", None, None, "b", "b"]]
    got = numbered(spark.createDataFrame(rows, "k string, v double, _own string"), ["k"], ["v"], "n", piece_bits=bits)
    by = {}
    for k, v, _ in sorted(rows, key=lambda x: x[1]):
        by.setdefault(k, []).append(v)
    assert got.columns == ["k", "v", "_own", "n"]
    assert sorted((x.k or "", x.v, x.n) for x in got.collect()) == sorted((k or "", v, n) for k, vs in by.items() for n, v in enumerate(vs, 1))


def test_log_tails_are_cut_before_the_exchange(spark):
    lines = spark.createDataFrame([("long", n, "x" * 9) for n in range(400)] + [("short", n, None) for n in range(5)], "log string, line_no bigint, text string")
    out = quality.rotate_logs(lines, 2_000, 7)
    assert sorted((x.log, x.line_no, x.text) for x in out.filter("log = 'long'").collect()) == [("long", -1, "--- rotated ---")] + [("long", n, "x" * 9) for n in range(393, 400)]
    assert out.filter("log = 'short'").count() == 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("bits", [3, 13])
def test_cues_without_a_bound_in_time(spark, bits):
    """One medium of one long chain of texts, folded in pieces."""
    r = random.Random(bits)
    texts = ["a line of text", "a line of text!", "another", "", "a line of"]
    rows = [(1, 10 * i, i, r.choice(texts), r.choice("pqr")) for i in range(200)] + [(2, 5, 0, "same", "p"), (2, 9, 1, "same", "q")] + [(3, i, i, "same", None) for i in range(50)]
    df = spark.createDataFrame(rows, "media_id bigint, t_ms bigint, ord bigint, text string, trans string").repartition(4)

    similar, either, cue, first = [], [], None, None
    for m, t, o, text, trans in rows:
        if first and first[0] == m and (first[1] == text or (trans is not None and first[2] == trans) or (trans is None and first[2] is None)):
            either[-1][3] = t + 1_500
        else:
            first = (m, text, trans)
            either.append([m, o, max(t - 200, 0), t + 1_500, trans])
        if cue and cue[0] == m and text and folds.alike(cue[4], text):
            cue[3], cue[4] = t + 1_500, text if len(text) > len(cue[4]) else cue[4]
        else:
            cue = [m, o, t, t + 1_500, text] if text else None
            similar += [cue] if cue else []
    key = lambda x: tuple("" if v is None else v for v in x)
    assert sorted(map(key, folds.consecutive_similar(df.drop("trans"), piece_bits=bits).collect())) == sorted(map(key, similar))
    assert sorted(map(key, folds.consecutive_either(df, piece_bits=bits).drop(*"xywh").collect())) == sorted(map(key, either))
