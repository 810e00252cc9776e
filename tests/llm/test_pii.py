import random
import re

from pyspark.sql import functions as F

from cuelake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    out = {}
    for kind, p in PATTERNS.items():
        spans = []
        for m in re.finditer(p, text):
            v, d = m.group(), [c for c in m.group() if c.isdigit()]
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else True,
                "card": 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                spans.append(m.span())
        out[kind] = spans
    return out


def test_base_spans_equal_patterns():
    r = random.Random(5)
    texts = ["", "a@b.c@d.e", "x@y@z.w", "@a.b", "a.@b.c.", "é1.2.3.4é", "1.2.3.4.5.6.7.8", "001.2.3.0255 256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+49 (30) 123-4567 +1 2", "++1 2 3 4 5 6 7 8)", "x" * 50_000, "9" * 4_000, "+1" + "-" * 3_000, "1 " * 3_000]
    texts += ["".join(r.choice("ab@.@-+ 0123456789.4()é") for _ in range(r.randrange(60))) for _ in range(20_000)]
    for t in texts:
        assert pii.base_spans(t) == naive(t), t


def test_terms_that_disclose(spark):
    rows = [(i, f"filler{i} words one two three nickname jo.do@ex.com seen here now {i}") for i in range(6)]
    rows += [(10 + i, "one two three here now seen words " * 40) for i in range(20)]
    rows += [(40, None), (41, ""), (None, "call +49 30 1234567 now"), (0, "ties 10.0.0.1"), (0, "ties 10.0.0.1")]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id bigint, text string, base string")
    spans = pii.personal_data(docs)
    got = {(r.doc_id, tuple(r.base), tuple(r.terms)) for r in spans.collect()}
    at = rows[0][1].index("nickname")
    assert (0, ("email:38:50",), (f"term:{at}:{at + 8}",)) in {(d, b, t) for d, b, t in got} or any(d == 0 and f"term:{at}:{at + 8}" in t for d, b, t in got)
    assert all(not t for d, b, t in got if not b) and spans.count() == len(rows)
    assert not any(":seen" in x for _, _, t in got for x in t)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, spans).filter("doc_id < 10 OR doc_id > 39").collect()}
    assert "[EMAIL]" in clean[1] and "nickname" not in clean[1] and clean[40] is None


def test_disclosing_terms_are_found_and_removed_at_any_distance(spark):
    far = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"alias opens {far} mail jo@ex.com near codename and {far} codename closes alias") for i in range(4)]
    rows += [(10 + i, f"opens {far} mail near and closes here {i}") for i in range(30)]
    rows += [(50, "alias codename without the entity")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = pii.personal_data(docs)
    got = {r.doc_id: r.terms for r in spans.collect()}
    want = [f"term:{m.start()}:{m.end()}" for m in re.finditer("alias|codename", rows[0][1])]
    assert len(want) == 4 and all(got[i] == want for i in range(4))
    assert all(not got[d] for d, _ in rows[4:])
    text = pii.sanitise(docs, spans).filter("doc_id = 1").first().text
    assert "alias" not in text and "codename" not in text and "[EMAIL]" in text and "w39" in text


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.personal_data(docs).collect() == []
    assert pii.sanitise(docs, pii.personal_data(docs)).select(F.count("*")).first()[0] == 0


def test_disclosure_equals_brute_force(spark):
    import math
    from collections import Counter

    r = random.Random(11)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        said = r.choices(words, k=r.randrange(1, 30))
        if i % 9 == 0:  # a domain that a word gives away
            said += ["insider", f"p{i}@corp.example", "w3"]
        if i % 40 == 0:
            said += ["nick", "boss@corp.example", f"10.1.{i % 7}.9"]
        r.shuffle(said)
        rows.append((i, " ".join(said)))
    rows += [(None, rows[0][1]), (5, rows[0][1]), (6, None), (7, "")]
    find = re.compile(r"[^\x20\x09-\x0D]+")
    held, df, df_e, met = [], Counter(), Counter(), Counter()
    for _, text in rows:
        text = text or ""
        base = pii.base_spans(text)
        spans = [x for v in base.values() for x in v]
        names = {n for k, v in base.items() for s, e in v for n in pii.entity_names(k, text[s:e])}
        free = {m.group() for m in find.finditer(text) if all(m.end() <= s or m.start() >= e for s, e in spans)}
        held.append((text, spans, names))
        df.update(set(find.findall(text)))
        df_e.update(names)
        met.update((n, t) for n in names for t in free)
    total = len(rows)
    bad = set()
    for (n, t), both in met.items():
        p_e = df_e[n] / total
        if both >= (pii.CLASS_SUPPORT if n & 3 else pii.SUPPORT) and df_e[n] < total and math.log((both / total) / (df[t] / total * p_e)) >= -pii.DISCLOSURE * math.log(p_e):
            bad.add((n, t))
    assert {t for n, t in bad if n & 3} >= {"insider"} and {t for n, t in bad if not n & 3} >= {"nick"}
    want = []
    for (doc, _), (text, spans, names) in zip(rows, held):
        cut = [m for m in find.finditer(text) if any((n, m.group()) in bad for n in names) and all(m.end() <= s or m.start() >= e for s, e in spans)]
        clean, at = "", 0
        for s, e, put in sorted([(s, e, f"[{k.upper()}]") for k, v in pii.base_spans(text).items() for s, e in v] + [(m.start(), m.end(), "") for m in cut]):
            clean, at = clean + text[at:s] + put, e
        want.append((str(doc), [f"term:{m.start()}:{m.end()}" for m in cut], clean + text[at:] if spans else None))
    got = [(str(x.doc_id), x.terms, x.clean) for x in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
