"""Dictionaries as tables, and texts rewritten with them."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions import text as t
from cuelake.operators import trie

#: Layers from the weakest to the strongest.
LAYERS = ["Babylon", "LacViet", "ThieuChuu", "PhienAm", "VietPhrase", "ChineseModern", "Names"]
#: File order of the first-sense loader, the last one wins.
FIRST_SENSE_LAYERS = ["VietPhrase", "Names", "PhuDe", "ChineseModern", "LacViet"]
#: Layers whose lines may be # comments.
COMMENTED = ["ChineseModern", "Shortcuts"]
#: Glossary of pronouns and titles.
GLOSSARY = [("你", "bạn"), ("我", "tôi"), ("他", "anh ấy"), ("她", "cô ấy"), ("师兄", "sư huynh"), ("师妹", "sư muội"), ("师傅", "sư phụ"), ("宗门", "tông môn")]
#: Entries of an otherwise empty lexicon.
SEED = [
    ("你好", "xin chào"), ("谢谢", "cảm ơn"), ("再见", "tạm biệt"), ("什么", "cái gì"), ("越南", "Việt Nam"), ("中国", "Trung Quốc"), ("我", "ta/tôi"), ("你", "ngươi/bạn"),
    ("他", "hắn/anh ấy"), ("她", "nàng/cô ấy"), ("是", "là"), ("不", "không"), ("的", "của"), ("在", "tại/ở"), ("了", "rồi"), ("要", "muốn/cần"), ("去", "đi"),
]
#: Slang that detection looks for.
SLANG = [
    ("破防", "sụp đổ / xé lòng"), ("绝绝子", "đỉnh kout / hết nước chấm"), ("硬核", "xịn xò / bá đạo"), ("显眼包", "thánh gây chú ý"), ("YYDS", "mãi đỉnh"), ("芭比Q了", "toang rồi"),
    ("泰裤辣", "quá ngầu"), ("栓Q", "cảm ơn nhiều"), ("特种兵式", "kiểu lính đặc nhiệm"), ("沉浸式", "kiểu đắm chìm"), ("搭子", "cạ cứng / bạn đồng hành"), ("尊嘟假嘟", "thật á / đùa à"),
]
MAX_KEY = 50
#: Whole-word rules that become patterns of the plan, which are compiled once; more of them are compiled for each text.
FEW_RULES = 200


def scan_lines(spark, path: str, layer: str, priority: int) -> DataFrame:
    """(layer, priority, line_no, line) of a text file read whole."""
    from cuelake.sources.subtitles import decode_bytes

    whole = spark.read.format("binaryFile").load(path).select(decode_bytes(F.col("content")).alias("x"))
    return whole.select(F.lit(layer).alias("layer"), F.lit(priority).alias("priority"), F.posexplode(F.split("x", r"\r\n|\r|\n")).alias("line_no", "line"))


def parse_entries(lines: DataFrame) -> DataFrame:
    """(layer, priority, line_no, key, value): key=value at the first =, stripped; blank lines
    and lines without = go, and # comments of the layers that have them."""
    raw = t.strip(F.col("line"))
    pair = F.split(raw, "=", 2)
    kept = lines.filter(raw.contains("=") & ~(F.col("layer").isin(COMMENTED) & raw.startswith("#")))
    return kept.select("layer", "priority", "line_no", t.strip(F.get(pair, F.lit(0))).alias("key"), t.strip(F.get(pair, F.lit(1))).alias("value"))


def word_list(lines: DataFrame) -> DataFrame:
    raw = t.strip(F.col("line"))
    return lines.filter((raw != "") & ~raw.startswith("#")).select(raw.alias("term")).distinct()


def clean_values(entries: DataFrame) -> DataFrame:
    """Values by the habits of their layer."""
    v, layer = F.col("value"), F.col("layer")
    first = lambda x, mark: t.strip(F.split(x, mark)[0])
    cleaned = (
        F.when(layer == "Babylon", first(v, ";"))
        .when(layer == "LacViet", first(F.regexp_replace(F.regexp_replace(v, r"✚\[[^\]]*\]", ""), r"\\n\\t\d+\.", ";"), "[;,]"))
        .when(layer == "ThieuChuu", first(first(v, r"\["), ","))
        .when(layer == "PhienAm", first(v, r"\|"))
        .otherwise(v)
    )
    return entries.withColumn("value", t.strip(cleaned))


def last_sense(value: Column) -> Column:
    """The last alternative of /, else of |."""
    end = lambda mark: t.strip(F.element_at(F.split(value, mark), -1))
    return F.when(value.contains("/"), end("/")).when(value.contains("|"), end(r"\|")).otherwise(value)


def first_sense(value: Column) -> Column:
    return t.strip(F.split(t.strip(F.split(value, "/")[0]), ";")[0])


def merge_layers(entries: DataFrame) -> DataFrame:
    """One entry a key: the strongest layer, within it the last line."""
    best = F.max(F.struct("priority", "line_no", "layer", "value")).alias("b")
    return entries.filter("key <> ''").groupBy("key").agg(best).select("key", F.col("b.value").alias("value"), F.col("b.layer").alias("layer"))


def load_last_sense(lines: DataFrame) -> DataFrame:
    e = clean_values(parse_entries(lines))
    senses = F.when(F.col("layer").isin("VietPhrase", "ChineseModern", "Names"), last_sense(F.col("value"))).otherwise(F.col("value"))
    return merge_layers(e.withColumn("value", senses))


def load_first_sense(lines: DataFrame) -> DataFrame:
    """First alternatives; entries whose key is all ASCII, or whose value is empty, go."""
    rank = F.array_position(F.array(*map(F.lit, FIRST_SENSE_LAYERS)), F.col("layer")).cast("int")
    e = parse_entries(lines.withColumn("layer", F.col("layer"))).withColumn("priority", rank).filter("priority > 0")
    e = e.withColumn("value", first_sense(F.col("value"))).filter(F.col("key").rlike(r"[^\x00-\x7F]") & (F.col("value") != ""))
    return merge_layers(e)


def or_seed(lexicon: DataFrame) -> DataFrame:
    """The lexicon, or the seed where it has no entry (decided in the plan, not before it)."""
    spark = lexicon.sparkSession
    seed = spark.createDataFrame(SEED, "key string, value string")
    some = lexicon.select(F.lit(1).alias("one")).limit(1)
    return lexicon.select("key", "value").unionByName(seed.withColumn("one", F.lit(1)).join(F.broadcast(some), "one", "left_anti").drop("one"))


def statistics(entries: DataFrame) -> DataFrame:
    return entries.groupBy("layer").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"))


def merge_slang(have: DataFrame, new: DataFrame, *, force: bool = False) -> DataFrame:
    """(zh, vi, category, source, written): new entries over old, but not over Custom ones."""
    fields = ["vi", "category", "source"]
    o = have.select("zh", *[F.col(c).alias(f"o_{c}") for c in fields], F.lit(True).alias("old"))
    n = new.filter(F.trim("zh") != "").select(F.trim("zh").alias("zh"), *[F.col(c).alias(f"n_{c}") for c in fields], F.lit(True).alias("fresh"))
    take = F.col("fresh").isNotNull() & (F.lit(force) | ~F.coalesce(F.col("o_source") == "Custom", F.lit(False)))
    return o.join(n.hint("merge"), "zh", "full").select("zh", *[F.when(take, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in fields], take.alias("written"))


def upsert(have: DataFrame, new: DataFrame, key: str, *, overwrite: bool = True) -> DataFrame:
    """Rows by key: new ones over old (or only beside them); blank keys are refused."""
    new = new.withColumn(key, F.trim(key)).filter(F.col(key) != "")
    if overwrite:
        return have.join(new.select(key).hint("merge"), key, "left_anti").unionByName(new)
    return have.unionByName(new.join(have.select(key).hint("merge"), key, "left_anti"))


def delete(have: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return have.join(keys.select(F.trim(key).alias(key)).hint("merge"), key, "left_anti")


def backfill(have: DataFrame, seed: DataFrame, key: str, least: int = 40) -> DataFrame:
    """The seed's other keys are added while the table has fewer than `least` entries."""
    few = have.groupBy().agg((F.count("*") < least).alias("few")).filter("few").select(F.lit(1).alias("one"))
    missing = seed.join(have.select(key).hint("merge"), key, "left_anti").withColumn("one", F.lit(1)).join(F.broadcast(few), "one", "left_semi").drop("one")
    return have.unionByName(missing)


def sync_report(sources: DataFrame, have: DataFrame) -> DataFrame:
    """Entries added, total and whether anything was fetched, of (source_no, zh) rows."""
    new = sources.select("zh").distinct().join(have.select("zh").hint("merge"), "zh", "left_anti").agg(F.count("*").alias("added"))
    total = have.select("zh").union(sources.select("zh")).distinct().agg(F.count("*").alias("total"))
    fetched = sources.agg((F.count("*") > 0).alias("fetched"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(new).join(F.broadcast(one(total)), "one").join(F.broadcast(one(fetched)), "one").drop("one")


def pairs_array(pairs: DataFrame, *order: Column, max_entries: int = 5_000) -> Column:
    """A bounded table of (key, value) as one array for replacement folds, in this order.

    The array is a scalar subquery, gathered once and meant for rule tables; more than
    `max_entries` raise an error. See replace_longest and translate_longest for lexicons.
    """
    keyed = pairs.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "key", "value").alias("x")).limit(max_entries + 1)
    one = keyed.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("p"))
    return one.select(F.when(F.size("p") > max_entries, F.raise_error(F.lit(f"more than {max_entries} rules"))).otherwise(F.col("p")).alias("p")).scalar()


def rewrite_distinct(rows: DataFrame, column: str, new: str, change) -> DataFrame:
    """Adds `new` = change(text column), worked out once for each distinct text."""
    texts = rows.select(column).distinct().withColumn(new, change(F.col(column)))
    return rows.join(texts.hint("merge"), rows[column].eqNullSafe(texts[column]), "left").select(rows["*"], texts[new])


def _with_pairs(texts: DataFrame, pairs: Column, change) -> DataFrame:
    """Texts (text) with `out`; the pairs are a column first, as folds take no subquery."""
    return texts.withColumn("_p", pairs).withColumn("out", change(F.col("text"), F.col("_p"))).drop("_p")


def replace_longest(texts: DataFrame, pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds out: keys replaced, the longest first (ties by ord), each on the result so far,
    at most `limit` keys that occur. Empty keys are never replaced, a null value is empty,
    a null text stays null.

    The pairs are a dictionary of any size: a text meets the keys that it holds and those that their
    values bring, not the whole list.
    """
    known = trie.publish(pairs.select("key", "value", "ord"), -F.length("key"), F.col("ord"))

    @F.pandas_udf("string")
    def change(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts = b.fillna("").tolist()
            out = [x for start, stop in trie.slices(map(len, texts)) for x in trie.replaced(known, texts[start:stop], limit)]
            yield pd.Series(out, index=b.index, dtype=object).where(b.notna(), None)

    return texts.withColumn("out", change("text"))


def apply_glossary(texts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Adds out: the glossary in its own order, user entries over the fixed ones; squeezed."""
    spark = texts.sparkSession
    fixed = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(GLOSSARY)], "ord int, key string, value string")
    user = spark.createDataFrame([], "ord int, key string, value string") if pairs is None else pairs.select("ord", "key", "value")
    both = fixed.unionByName(user.withColumn("ord", F.col("ord") + 1000))
    last = both.groupBy("key").agg(F.min("ord").alias("ord"), F.max(F.struct("ord", "value")).alias("v")).select("ord", "key", F.col("v.value").alias("value"))
    out = _with_pairs(texts, pairs_array(last, F.col("ord")), t.replace_in_order)
    return out.withColumn("out", t.squeeze(F.col("out")))


def enforce_words(texts: DataFrame, pairs: DataFrame, *, longest_first: bool = False) -> DataFrame:
    """Adds out: whole-word replacement in any case (glossary terms, names, abbreviations)."""
    order = (-F.length("key"), F.col("ord")) if longest_first else (F.col("ord"),)
    rules = pairs_array(pairs, *order)
    few = texts.sparkSession.range(1).select(F.when(F.size(rules) <= FEW_RULES, rules).alias("p")).head().p
    if few is None:
        return _with_pairs(texts, rules, t.replace_words)
    return texts.withColumn("out", t.rewrite(F.col("text"), [(r.key, r.value) for r in few], ignore_case=True))


def find_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term, n): terms that occur in texts (id, text), with the number of their places from left
    to right without overlap; rows with one id count together.

    The terms are a dictionary of any size. Each text is looked up where it is read, in time
    that follows its length, and only what it holds goes on.
    """
    known = trie.publish(terms.select(F.col("term").alias("key")).distinct().withColumn("value", F.lit("")))
    kind = texts.schema["id"].dataType

    def rows(batches):
        for batch in batches:
            for start, stop in trie.slices(pc.utf8_length(batch["text"])):
                part = batch.slice(start, stop - start)
                row, found, n = trie.counted(known, ["" if x is None else x for x in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(row)), pa.array(found, pa.string()), pa.array(n)], names=["id", "term", "n"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    return texts.select("id", "text").mapInArrow(rows, schema).groupBy("id", "term").agg(F.sum("n").alias("n"))


def slang_table(spark) -> DataFrame:
    return spark.createDataFrame(SLANG, "term string, vi string")


def mask_terms(texts: DataFrame, terms: DataFrame, mask: str = "***") -> DataFrame:
    """Adds hits (terms that the text holds) and out: terms replaced by a mask, the longest first.
    A null text has no hit and stays null. The terms are a dictionary of any size."""
    pairs = terms.select(F.col("term").alias("key")).distinct().withColumn("value", F.lit(mask))
    known = trie.publish(pairs, -F.length("key"))

    @F.pandas_udf("hits int, out string")
    def change(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, hits, out = b.fillna("").tolist(), [], []
            for start, stop in trie.slices(map(len, texts)):
                held = texts[start:stop]
                row, _, _ = trie.counted(known, held)
                hits.append(np.bincount(row, minlength=len(held)).astype("int32"))
                out += trie.replaced(known, held)
            yield pd.DataFrame({"hits": np.concatenate(hits) if hits else np.empty(0, "int32"), "out": pd.Series(out, dtype=object).where(b.notna().to_numpy(), None)})

    return texts.withColumn("_m", change("text")).withColumns({"hits": F.col("_m.hits"), "out": F.col("_m.out")}).drop("_m")


#: ASCII marks copied one by one by the segmentation.
_COPIED = frozenset(",.!?()[]{}:;\"'<>~@#$%^&*_-+=/\\|")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def _segments(text: str, first: int, size, values: dict[int, str]) -> Iterator[str]:
    """Parts of one text of a batch that begins at place `first` of it; size and values as of Dictionary.longest."""
    at = 0
    while at < len(text):
        c = text[at]
        end = at + 1
        if c in _ALNUM:
            while end < len(text) and text[end] in _ALNUM:
                end += 1
            yield text[at:end]
        elif c.isspace() or c in _COPIED or not size[first + at]:
            yield c
        else:
            end = at + int(size[first + at])
            yield values[first + at]
        at = end


#: By code point: what is copied and never looked up.
_COPIED_AS_IT_IS = np.zeros(0x110000, bool)
_COPIED_AS_IT_IS[[*map(ord, sorted(_ALNUM | _COPIED)), *(i for i in range(0x110000) if chr(i).isspace())]] = True


def segmented(known: trie.Dictionary, texts: list[str]) -> list[str]:
    """The parts of each text, joined by spaces."""
    cps, starts = trie.code_points(texts)
    stop = np.repeat(starts[1:], np.diff(starts))
    size, values = known.longest(cps, stop, np.flatnonzero(~_COPIED_AS_IT_IS[cps]), MAX_KEY)
    return [" ".join(_segments(x, s, size, values)) for x, s in zip(texts, starts.tolist())]


def translate_longest(texts: DataFrame, lexicon: DataFrame, shortcuts: DataFrame | None = None) -> DataFrame:
    """Adds out to texts (text): greedy longest match from left to right, word by word.

    Space and ASCII marks are copied, runs of letters and digits copied whole, everything
    else is looked up (at most MAX_KEY characters) or copied; parts are joined by spaces and
    tidied, then abbreviations and phrase rules apply. Entries that begin with a copied
    character are never looked up and are left out. The lexicon has one value a key and any size: it
    is a dictionary in the shared folder, of which workers open what their texts need. Texts are sent as
    they come: make them distinct before where many are alike.
    """
    usable = lexicon.select("key", "value").filter(F.length("key").between(1, MAX_KEY) & ~F.substring("key", 1, 1).isin(*sorted(_ALNUM | _COPIED)))
    known = trie.publish(usable)

    @F.pandas_udf("string")
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts = b.fillna("").tolist()
            out = [x for start, stop in trie.slices(map(len, texts)) for x in segmented(known, texts[start:stop])]
            yield pd.Series(out, dtype=object).where(b.notna().to_numpy(), None)

    out = texts.withColumn("_o", segment("text")).withColumn("_o", t.tidy_marks(F.col("_o")))
    if shortcuts is not None:
        out = out.withColumn("_p", pairs_array(shortcuts, F.col("ord"))).withColumn("_o", t.replace_words(F.col("_o"), F.col("_p"))).drop("_p")
    return out.withColumn("out", t.phrase_style(F.col("_o"))).drop("_o")


def language_candidates(label: Column) -> Column:
    """Reader languages of a label; the first rule that matches."""
    x = F.lower(F.coalesce(label, F.lit("auto")))
    has = lambda *words: x.rlike("|".join(rf"\Q{w}\E" for w in words))
    codes = lambda *c: F.array(*map(F.lit, c))
    out = F.when(has("phồn", "phon", "ch_tra", "traditional"), codes("ch_tra+en", "ch_sim+en", "en"))
    out = out.when(has("giản", "gian", "ch_sim", "simplified", "trung", "chinese", "auto", "tự động"), codes("ch_sim+en", "ch_tra+en", "en"))
    out = out.when(has("việt", "viet", "vi"), codes("vi+en", "ch_sim+en", "en")).when(has("anh", "english", "en"), codes("en", "ch_sim+en"))
    for names, code in ((("nhật", "ja"), "ja"), (("hàn", "ko"), "ko"), (("pháp", "fr"), "fr"), (("đức", "de"), "de"), (("tây ban nha", "spanish", "es"), "es"), (("nga", "ru"), "ru"), (("thái", "thai", "th"), "th")):
        out = out.when(has(*names), codes(f"{code}+en"))
    return out.otherwise(codes("ch_sim+en", "ch_tra+en", "en"))


#: The second order of language rules, case-sensitive; without a match vi and en.
READERS = [
    (("Tự động", "auto"), "ch_sim"), (("Trung Giản Thể", "ch_sim"), "ch_sim"), (("Trung Phồn Thể", "ch_tra"), "ch_tra"), (("Việt", "vi"), "vi"), (("Anh", "en"), "en"), (("Nhật", "ja"), "ja"),
    (("Hàn", "ko"), "ko"), (("Pháp", "fr"), "fr"), (("Đức", "de"), "de"), (("Tây Ban Nha", "es"), "es"), (("Nga", "ru"), "ru"), (("Thái", "th"), "th"),
]


def reader_languages(label: Column) -> Column:
    """Languages that a sampled reader is opened with: the first rule whose words the label holds."""
    rules = [(label.rlike("|".join(rf"\Q{w}\E" for w in words)), F.array(*map(F.lit, dict.fromkeys([code, "en"])))) for words, code in READERS]
    return F.coalesce(*[F.when(hit, codes) for hit, codes in rules], F.array(F.lit("vi"), F.lit("en")))


def iso_language(label: Column) -> Column:
    known = {"Vietnamese": "vi", "English": "en", "Chinese": "zh-CN", "Japanese": "ja", "Korean": "ko", "French": "fr", "German": "de", "Spanish": "es", "auto": "auto"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), label), label)
