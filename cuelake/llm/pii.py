"""Personal data: fixed patterns, and terms that the corpus shows to reveal it."""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import batch_words, staged

KINDS = ("email", "ip", "card", "phone")
#: Documents in which a term and an entity, or a class of entities, must meet before they count as a pair.
SUPPORT, CLASS_SUPPORT = 3, 6
#: Share of an entity's information, PMI(term; entity) / IC(entity), that a term may reveal.
DISCLOSURE = 0.8
#: Distinct words, or pairs of an entity and a word, a task counts before it passes the counts on.
COUNTED = 300_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot start inside a run of digits whose first digit gave none: the look-behind
# changes no result and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from their @ in linear time: neither
    side of a match holds another @, so a match starts at the local run before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind; failing matches are dropped."""
    out: dict = {k: [] for k in KINDS}
    out["email"] = emails(text)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def entity_names(kind: str, value: str) -> list[int]:
    """64-bit names of what a value stands for: itself (e-mails in lower case, the others by
    their digits), its class (domain, network, issuer or dialling prefix) and its kind.

    The last two bits hold the level: 0 the value, 1 the class, 2 the kind.
    """
    digits = "".join(c for c in value if c.isdigit())
    norm = {"email": value.lower(), "ip": value}.get(kind, digits)
    group = {"email": norm.rpartition("@")[2], "ip": ".".join(norm.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
    name = lambda level, text: int.from_bytes(hashlib.blake2b(f"{kind}:{text}".encode(), digest_size=8).digest(), "big", signed=True) & ~3 | level
    return [name(0, norm), name(1, group), name(2, "")]


def occurrences(text: str) -> dict[str, list[int]]:
    """Starts of the words that overlap no base span, by word."""
    taken = sorted(s for found in base_spans(text).values() for s in found)
    reach, k, out = 0, 0, {}
    for m in _WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= m.start():
            out.setdefault(m.group(), []).append(m.start())
    return out


FOUND = "doc_id bigint, _row bigint, base array<string>, entities array<bigint>, text string"


def find_entities(docs: DataFrame) -> DataFrame:
    """Per row: base spans as kind:start:end, and, where there are any, the names of the
    entities and the text."""

    def rows(batches):
        for b in batches:
            base, entities, texts = [], [], []
            for x in b["text"]:
                text = x.as_py() or ""
                spans = base_spans(text)
                base.append([f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k]])
                entities.append(sorted({n for k in KINDS for s, e in spans[k] for n in entity_names(k, text[s:e])}))
                texts.append(text if entities[-1] else None)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["_row"], pa.array(base, pa.list_(pa.string())), pa.array(entities, pa.list_(pa.int64())), pa.array(texts, pa.string())], names=["doc_id", "_row", "base", "entities", "text"])

    return docs.mapInArrow(rows, FOUND)


def counted(frame: DataFrame, columns: dict[str, str], batch_counts) -> DataFrame:
    """The counts that batch_counts gives of each batch, added up in each task first, as
    `columns` (name: type) and n."""
    schema = pa.schema([*((c, pa.int64() if t == "bigint" else pa.string()) for c, t in columns.items()), ("n", pa.int64())])

    def rows(batches):
        total: dict = {}

        def batch():
            keys = zip(*total) if len(columns) > 1 else [list(total)]
            return pa.RecordBatch.from_arrays([*(pa.array(k, f.type) for k, f in zip(keys, schema)), pa.array(list(total.values()), pa.int64())], schema=schema)

        for b in batches:
            for some in batch_counts(b):
                for k, n in some:
                    total[k] = total.get(k, 0) + n
                if len(total) > COUNTED:
                    yield batch()
                    total.clear()
        if total:
            yield batch()

    return frame.mapInArrow(rows, ", ".join(f"{c} {t}" for c, t in columns.items()) + ", n bigint").groupBy(*columns).agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(term, n): rows that hold each word of the corpus."""

    def batch_counts(b):
        import numpy as np

        codes, dictionary, starts = batch_words(b["text"])
        size = max(len(dictionary), 1)
        once = np.unique(np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * size + codes) % size
        yield zip(dictionary.to_pylist(), np.bincount(once, minlength=len(dictionary)).tolist())

    return counted(docs.select("text"), {"term": "string"}, batch_counts)


def needed(support: int, class_support: int) -> Column:
    """Rows in which a pair of the entity must be met."""
    return F.when(F.col("entity").bitwiseAND(F.lit(3)) == 0, support).otherwise(class_support)


def recurring(found: DataFrame, support: int, class_support: int) -> tuple[DataFrame, DataFrame]:
    """(entity, n_e) of the entities in as many rows as a pair needs (no pair of another can
    be met so often), and the rows that hold them: doc_id, _row, text, entities."""
    some = found.filter(F.size("entities") > 0)
    each = some.select("doc_id", "_row", F.explode("entities").alias("entity"))
    known = staged(each.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= needed(support, class_support)), "recurring")
    rows = each.join(known.hint("merge"), "entity").groupBy(F.col("doc_id").alias("_d"), F.col("_row").alias("_r")).agg(F.collect_set("entity").alias("entities"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r"))
    return known, staged(some.drop("entities").join(rows.hint("merge"), same).select("doc_id", "_row", "text", "entities"), "held")


def disclosing_pairs(known: DataFrame, held: DataFrame, counts: DataFrame, total: int, *, support: int = SUPPORT, class_support: int = CLASS_SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term) pairs whose co-occurrence reveals too much of the entity.

    p(t), p(e) and p(t, e) are shares of the `total` rows: those that hold t, e, and both,
    however far apart. PMI = ln(p(t, e) / (p(t) p(e))) is the information t gives about
    e, IC = -ln p(e) all there is to know (none of an entity in every row). Pairs met in
    `support` rows or more (`class_support` for classes and kinds, which many rows hold)
    with PMI >= disclosure * IC are returned.
    """

    def batch_counts(b):
        for text, entities in zip(b["text"].to_pylist(), b["entities"].to_pylist()):
            terms = list(occurrences(text))
            for e in entities:
                yield (((e, t), 1) for t in terms)

    met = counted(held.select("text", "entities"), {"entity": "bigint", "term": "string"}, batch_counts)
    pairs = met.filter(F.col("n") >= needed(support, class_support)).withColumnRenamed("n", "n_te")
    p = lambda c: F.col(c) / F.lit(float(total))
    scored = pairs.join(known.hint("merge"), "entity").join(counts.hint("merge"), "term").filter(F.col("n_e") < total)
    return scored.filter(F.log(p("n_te") / (p("n") * p("n_e"))) >= -disclosure * F.log(p("n_e"))).select("entity", "term")


def located(held: DataFrame) -> DataFrame:
    """(doc_id, _row, entities, term, starts): every word outside base spans."""
    kind = pa.schema([("doc_id", pa.int64()), ("_row", pa.int64()), ("entities", pa.list_(pa.int64())), ("term", pa.string()), ("starts", pa.list_(pa.int32()))])

    def rows(batches):
        for b in batches:
            for doc, row, text, entities in zip(*(b[c].to_pylist() for c in ("doc_id", "_row", "text", "entities"))):
                at = occurrences(text)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([doc] * n, [row] * n, [entities] * n, list(at), list(at.values())), kind)], schema=kind)

    return held.select("doc_id", "_row", "text", "entities").mapInArrow(rows, "doc_id bigint, _row bigint, entities array<bigint>, term string, starts array<int>")


def sanitised(text: Column, spans: Column) -> Column:
    """Text with base spans generalised to their kind ([EMAIL] ...) and terms removed; where
    spans (kind:start:end) overlap, the first in text order counts."""
    parts = F.array_sort(F.transform(spans, lambda x: F.struct(
        F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end"), F.split(x, ":")[0].alias("kind"))))
    put = lambda kind: F.when(kind == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        parts, start,
        lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(
            x["end"].alias("at"), F.concat(s["out"], F.array(F.substr(text, s["at"] + 1, x["start"] - s["at"]), put(x["kind"]))).alias("out"))),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1)),
    )


def personal_data(docs: DataFrame, *, support: int = SUPPORT, class_support: int = CLASS_SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, _row, base and terms: spans (kind:start:end, code points) of every row; clean:
    its text without them (see sanitised), null where there are none.

    base holds the fixed patterns by kind, then start; terms every occurrence, in the rows
    that hold a protected entity, of the words that disclose it (see disclosing_pairs), as
    term:start:end. Protected are single values, their classes (a mail domain, a network)
    and their kinds. Base spans never depend on the corpus. One row a row of docs; null
    texts are empty; null and repeated ids are carried (_row is a tag of the text); an
    empty table gives an empty table.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("_row"), "text")
    found = staged(find_entities(rows), "entities")
    known, held = recurring(found, support, class_support)
    bad = disclosing_pairs(known, held, staged(word_counts(rows), "words"), found.count(), support=support, class_support=class_support, disclosure=disclosure)
    bad = staged(bad.groupBy(F.col("term").alias("_t")).agg(F.collect_set("entity").alias("_of")), "disclosing")
    at = located(held).join(bad.hint("merge"), (F.col("term") == F.col("_t")) & F.arrays_overlap("entities", "_of"))
    spans = F.transform("starts", lambda x: F.struct(x.alias("start"), (x + F.length("term")).alias("end")))
    hits = at.select("doc_id", "_row", spans.alias("s")).distinct().groupBy("doc_id", "_row").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
    spans = F.transform("s", lambda x: F.concat_ws(":", F.lit("term"), x["start"], x["end"]))
    hits = hits.select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), spans.alias("terms"))
    joined = found.select("doc_id", "_row", "base", "text").join(hits.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")), "left")
    joined = joined.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    clean = F.when(F.size("base") > 0, sanitised(F.col("text"), F.concat("base", "terms")))
    return joined.select("doc_id", "_row", "base", "terms", clean.alias("clean"))


def sanitise(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the texts that personal_data cleaned; null and clean texts stay."""
    one = spans.filter("clean IS NOT NULL").select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), F.col("clean").alias("_clean")).distinct()
    joined = docs.withColumn("_row", F.xxhash64("text")).join(one.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")), "left")
    return joined.withColumn("text", F.coalesce("_clean", "text")).select(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda k: F.size(F.filter("base", lambda x: x.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    return personal_data(docs).select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join(F.concat("base", "terms"), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_terms"), (F.size("base") > 0).alias("found"), F.sha2("clean", 256).alias("clean_sha256"),
    )
