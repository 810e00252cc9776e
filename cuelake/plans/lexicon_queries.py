"""Queries over dictionaries and texts, with their SQL."""
from pyspark.sql import functions as F

from cuelake.functions import text as t
from cuelake.operators import lexicon as lex
from cuelake.operators.keyed import KeyedTable
from cuelake.operators.shared import new_path
from cuelake.plans import bindings as b
from cuelake.plans.bindings import V_LEXICON_LINES, V_LINES, V_PAIRS
from cuelake.plans.registry import query

ENTRIES = "en AS (SELECT layer, priority, line_no, trim(split_part(line, '=', 1)) AS key, trim(substr(line, strpos(line, '=') + 1)) AS value FROM v_lex WHERE contains(line, '=') AND NOT (layer IN ('ChineseModern', 'Shortcuts') AND line LIKE '#%'))"
CLEAN = r"""cl AS (SELECT layer, priority, line_no, key, trim(CASE layer WHEN 'Babylon' THEN split_part(value, ';', 1) WHEN 'LacViet' THEN regexp_extract(regexp_replace(value, '✚\[[^\]]*\]', '', 'g'), '^[^;,]*')
 WHEN 'ThieuChuu' THEN split_part(split_part(value, '[', 1), ',', 1) WHEN 'PhienAm' THEN split_part(value, '|', 1) ELSE value END) AS value FROM en)"""

#: Words of the prose with their counts join every lexicon query, so that it grows with the corpus.
PROSE = "wd AS (SELECT word, count(*) AS uses FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) u GROUP BY word)"


def words(spark, d):
    return b.table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("uses"))


def with_uses(spark, d, lexicon):
    """Entries of a lexicon (small) with the number of their uses in the prose."""
    w = words(spark, d)
    return lexicon.join(w.hint("merge"), lexicon["key"] == w["word"], "left").select(lexicon["*"], F.coalesce("uses", F.lit(0)).alias("uses"))


USES = "SELECT x.*, coalesce(wd.uses, 0) AS uses FROM ({}) x LEFT JOIN wd ON wd.word = x.key"


def distinct_lines(spark, d):
    return b.lines(spark, d).select("text").distinct()


@query("s7_lexicon_entries", USES.format("SELECT layer, line_no, key, value FROM en"), V_LEXICON_LINES, ENTRIES, PROSE)
def s7(spark, d):
    return with_uses(spark, d, lex.parse_entries(b.lexicon_lines(spark)).drop("priority"))


@query("l2_clean_values", USES.format("SELECT layer, line_no, key, value FROM cl"), V_LEXICON_LINES, ENTRIES, CLEAN, PROSE)
def l2(spark, d):
    return with_uses(spark, d, lex.clean_values(lex.parse_entries(b.lexicon_lines(spark))).drop("priority"))


SQUEEZE = "trim(regexp_replace({}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
#: Unicode white space removed at both ends.
STRIPPED = "regexp_replace({}, '^[\\s\\x{{85}}\\p{{Z}}]+|[\\s\\x{{85}}\\p{{Z}}]+$', '', 'g')"
LAST = "la AS (SELECT layer, priority, line_no, key, CASE WHEN layer NOT IN ('VietPhrase', 'ChineseModern', 'Names') THEN value WHEN contains(value, '/') THEN trim(list_last(string_split(value, '/'))) WHEN contains(value, '|') THEN trim(list_last(string_split(value, '|'))) ELSE value END AS value FROM cl)"


@query("l1_layered_lexicon", USES.format("SELECT key, first(value ORDER BY priority DESC, line_no DESC) AS value, first(layer ORDER BY priority DESC, line_no DESC) AS layer FROM la WHERE key <> '' GROUP BY key"), V_LEXICON_LINES, ENTRIES, CLEAN, LAST, PROSE)
def l1(spark, d):
    return with_uses(spark, d, lex.load_last_sense(b.lexicon_lines(spark)))


@query("l3_last_sense", "SELECT text AS source, CASE WHEN contains(v, '/') THEN " + STRIPPED.format("list_last(string_split(v, '/'))") + " WHEN contains(v, '|') THEN " + STRIPPED.format("list_last(string_split(v, '|'))") + " ELSE v END AS sense FROM (SELECT DISTINCT text, replace(text, '. ', '/') AS v FROM v_lines) q", V_LINES)
def l3(spark, d):
    return distinct_lines(spark, d).select(F.col("text").alias("source"), lex.last_sense(F.replace("text", F.lit(". "), F.lit("/"))).alias("sense"))


@query("l4_first_sense_lexicon", USES.format("""SELECT key, first(value ORDER BY r DESC, line_no DESC) AS value, first(layer ORDER BY r DESC, line_no DESC) AS layer FROM (SELECT layer, line_no, key, trim(split_part(trim(split_part(value, '/', 1)), ';', 1)) AS value,
 list_position(['VietPhrase', 'Names', 'PhuDe', 'ChineseModern', 'LacViet'], layer) AS r FROM en) q WHERE r > 0 AND value <> '' AND regexp_matches(key, '[^\\x00-\\x7F]') GROUP BY key""".replace("\\\\", "\\")), V_LEXICON_LINES, ENTRIES, PROSE)
def l4(spark, d):
    return with_uses(spark, d, lex.load_first_sense(b.lexicon_lines(spark)))


@query("l5_seed_when_empty", "SELECT word AS key, CAST(uses AS VARCHAR) AS value FROM wd WHERE uses > 3", PROSE)
def l5(spark, d):
    return lex.or_seed(words(spark, d).filter("uses > 3").select(F.col("word").alias("key"), F.col("uses").cast("string").alias("value")))


HAVE = "have AS (SELECT word AS zh, lang AS vi, CASE WHEN length(word) % 3 = 0 THEN 'Custom' ELSE 'Auto' END AS source FROM (SELECT word, min(lang) AS lang FROM (SELECT unnest(string_split(text, ' ')) AS word, lang FROM documents WHERE doc_id % 2 = 0) u WHERE word <> '' GROUP BY word) q), fresh AS (SELECT word AS zh, max(lang) AS vi FROM (SELECT unnest(string_split(text, ' ')) AS word, lang FROM documents WHERE doc_id % 2 = 1) u WHERE trim(word, chr(10)) <> '' AND trim(word) = word AND word <> '' GROUP BY word)"


def slang(spark, d):
    w = b.table(spark, d, "documents").select("doc_id", "lang", F.explode(F.split("text", " ")).alias("zh")).filter("zh <> ''")
    have = w.filter("doc_id % 2 = 0").groupBy("zh").agg(F.min("lang").alias("vi")).withColumns({"category": F.lit("c"), "source": F.when(F.length("zh") % 3 == 0, "Custom").otherwise("Auto")})
    fresh = w.filter("doc_id % 2 = 1").groupBy("zh").agg(F.max("lang").alias("vi")).withColumns({"category": F.lit("n"), "source": F.lit("Web")})
    return have, fresh


@query("l6_protected_merge", "SELECT coalesce(h.zh, f.zh) AS zh, CASE WHEN f.zh IS NOT NULL AND coalesce(h.source, '') <> 'Custom' THEN f.vi ELSE h.vi END AS vi, CASE WHEN f.zh IS NOT NULL AND coalesce(h.source, '') <> 'Custom' THEN 'Web' ELSE h.source END AS source, f.zh IS NOT NULL AND coalesce(h.source, '') <> 'Custom' AS written FROM have h FULL JOIN fresh f ON h.zh = f.zh", HAVE)
def l6(spark, d):
    return lex.merge_slang(*slang(spark, d)).drop("category")


UPSERTED = "SELECT zh, vi FROM fresh UNION ALL SELECT zh, vi FROM have WHERE zh NOT IN (SELECT zh FROM fresh)"
DELETED = "SELECT zh, vi FROM have WHERE zh NOT IN (SELECT zh FROM fresh)"


@query("l7_upsert", UPSERTED, HAVE)
def l7(spark, d):
    have, fresh = slang(spark, d)
    return lex.upsert(have.select("zh", "vi"), fresh.select("zh", "vi"), "zh")


@query("l7_delete", DELETED, HAVE)
def l7b(spark, d):
    have, fresh = slang(spark, d)
    return lex.delete(have.select("zh", "vi"), fresh, "zh")


def slang_kept(spark, d):
    have, fresh = slang(spark, d)
    return KeyedTable.create(have.select("zh", "vi"), new_path(spark, "slang"), "zh"), fresh.select("zh", "vi")


@query("l7_table_upsert", UPSERTED, HAVE)
def l7_table(spark, d):
    """The same entries in a table that is changed in place."""
    table, fresh = slang_kept(spark, d)
    table.upsert(fresh)
    return table.read(spark)


@query("l7_table_delete", DELETED, HAVE)
def l7b_table(spark, d):
    table, fresh = slang_kept(spark, d)
    table.delete(fresh)
    return table.read(spark)


@query("l8_backfill", "SELECT zh, vi FROM have UNION ALL SELECT zh, vi FROM fresh WHERE zh NOT IN (SELECT zh FROM have) AND (SELECT count(*) FROM have) < 1000000", HAVE)
def l8(spark, d):
    have, fresh = slang(spark, d)
    return lex.backfill(have.select("zh", "vi"), fresh.select("zh", "vi"), "zh", 1_000_000)


@query("l9_sync_report", "SELECT (SELECT count(*) FROM fresh WHERE zh NOT IN (SELECT zh FROM have)) AS added, (SELECT count(*) FROM (SELECT zh FROM have UNION SELECT zh FROM fresh) u) AS total, (SELECT count(*) FROM fresh) > 0 AS fetched", HAVE)
def l9(spark, d):
    have, fresh = slang(spark, d)
    return lex.sync_report(fresh, have)


TERMS = ["the", "tion", "que", "und", "ist", "chè", "xyzzy"]
V_TERMS = "terms AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in TERMS) + "]) AS term)"


def terms(spark):
    return spark.createDataFrame([(x,) for x in TERMS], "term string")


COUNTS = "(length(text) - length(replace(text, term, ''))) // length(term)"


@query("j9_containment", f"SELECT media_id * 100000 + line_no AS id, term, {COUNTS} AS n FROM v_lines, terms WHERE contains(text, term)", V_LINES, V_TERMS)
def j9(spark, d):
    x = b.lines(spark, d).select((F.col("media_id") * 100_000 + F.col("line_no")).alias("id"), "text")
    return lex.find_terms(x, terms(spark))


@query("x10_slang_detection", "SELECT doc_id AS id, term FROM documents, (SELECT unnest(['破防', '绝绝子', '硬核']) AS term) s WHERE contains(text || CASE WHEN doc_id % 5 = 0 THEN '彻底破防了，绝绝子' ELSE '' END, term)")
def x10(spark, d):
    x = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat("text", F.when(F.col("doc_id") % 5 == 0, "彻底破防了，绝绝子").otherwise("")).alias("text"))
    return lex.find_terms(x, lex.slang_table(spark)).select("id", "term")


REPLACED = """ RECURSIVE dt AS (SELECT DISTINCT text FROM v_lines), ps AS (SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM v_pairs),
 f AS (SELECT text, text AS out, 0 AS k, 0 AS n FROM dt UNION ALL SELECT f.text, CASE WHEN n < {limit} THEN replace(out, key, value) ELSE out END, f.k + 1, n + CASE WHEN contains(out, key) THEN 1 ELSE 0 END FROM f JOIN ps ON ps.k = f.k + 1)
 SELECT text, out FROM f WHERE k = (SELECT count(*) FROM ps)"""


@query("x8_longest_first", "RECURSIVE WITH" + REPLACED.format(order="length(key) DESC, ord", limit=3).replace(" RECURSIVE", "", 1), V_LINES, V_PAIRS)
def x8(spark, d):
    return lex.replace_longest(distinct_lines(spark, d), b.pairs(spark), 3)


@query("w8_replacement_cap", "RECURSIVE WITH" + REPLACED.format(order="length(key) DESC, ord", limit=1).replace(" RECURSIVE", "", 1), V_LINES, V_PAIRS)
def w8(spark, d):
    return lex.replace_longest(distinct_lines(spark, d), b.pairs(spark), 1)


@query("x9_slang_replacement", "RECURSIVE WITH" + REPLACED.format(order="length(key) DESC, ord", limit=99).replace(" RECURSIVE", "", 1), V_LINES, V_PAIRS)
def x9(spark, d):
    return lex.replace_longest(distinct_lines(spark, d), b.pairs(spark))




@query("x11_glossary", "RECURSIVE WITH" + REPLACED.format(order="ord", limit=99).replace(" RECURSIVE", "", 1).replace("SELECT text, out FROM f", "SELECT text, " + SQUEEZE.format("out") + " AS out FROM f"), V_LINES, V_PAIRS)
def x11(spark, d):
    return lex.apply_glossary(distinct_lines(spark, d), b.pairs(spark))



@query("x12_enforce_words")
def x12(spark, d):
    return lex.enforce_words(distinct_lines(spark, d), b.pairs(spark))


@query("x13_proper_names")
def x13(spark, d):
    names = b.pairs(spark).select("ord", "key", F.initcap("key").alias("value"))
    return lex.enforce_words(distinct_lines(spark, d), names, longest_first=True)


@query("x14_abbreviations", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'one' ELSE source END || '/src10' AS out FROM documents")
def x14(spark, d):
    x = b.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/src10")).alias("text"))
    pairs = spark.createDataFrame([(0, "SRC1", "one")], "ord int, key string, value string")
    return lex.enforce_words(x, pairs).select("doc_id", "out")


@query("x14_abbreviations_in_prose", "SELECT text, regexp_replace(regexp_replace(text, '(?i)\\bis\\b', 'it is', 'g'), '(?i)\\bof\\b', '$1 of', 'g') AS out FROM (SELECT DISTINCT text FROM v_lines) q".replace("\\\\", "\\"), V_LINES)
def x14_prose(spark, d):
    """Whole words of every line, in any case."""
    pairs = spark.createDataFrame([(0, "IS", "it is"), (1, "of", "$1 of")], "ord int, key string, value string")
    return lex.enforce_words(distinct_lines(spark, d), pairs)


@query("x15_longest_match")
def x15(spark, d):
    # words that begin with an ASCII letter or digit are copied without a look-up
    lexicon = words(spark, d).filter(F.length("word").between(1, lex.MAX_KEY) & ~F.col("word").rlike("^[A-Za-z0-9]")).select(F.col("word").alias("key"), F.upper("word").alias("value"))
    return lex.translate_longest(distinct_lines(spark, d), lexicon)


@query("l10_censor_mask", """SELECT text, CAST((contains(text, 'the')::INT + contains(text, 'tion')::INT + contains(text, 'que')::INT + contains(text, 'und')::INT + contains(text, 'ist')::INT + contains(text, 'chè')::INT) AS INTEGER) AS hits,
 replace(replace(replace(replace(replace(replace(text, 'tion', '***'), 'chè', '***'), 'ist', '***'), 'que', '***'), 'the', '***'), 'und', '***') AS out FROM (SELECT DISTINCT text FROM v_lines) q""", V_LINES)
def l10(spark, d):
    return lex.mask_terms(distinct_lines(spark, d), terms(spark))


@query("a10_lexicon_statistics", "SELECT lang AS layer, count(*) AS n, count(DISTINCT word) AS n_keys FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) u GROUP BY lang")
def a10(spark, d):
    return lex.statistics(b.table(spark, d, "documents").select(F.col("lang").alias("layer"), F.explode(F.split("text", " ")).alias("key")))


@query("s8_word_list", "SELECT DISTINCT trim(text) AS term FROM v_lines WHERE trim(text) <> '' AND trim(text) NOT LIKE '#%'", V_LINES)
def s8(spark, d):
    return lex.word_list(b.lines(spark, d).withColumnRenamed("text", "line"))


@query("x1_clean_text", "SELECT media_id, line_no, lower(" + SQUEEZE.format("text") + ") AS text FROM v_lines", V_LINES)
def x1(spark, d):
    return b.lines(spark, d).select("media_id", "line_no", t.clean_text(F.col("text")).alias("text"))


@query("x3_cjk_spaces", "SELECT media_id, line_no, replace(text, '你 好 ,', '你好,') AS text FROM (SELECT media_id, line_no, '你 好 ,' || text AS text FROM v_lines) q", V_LINES)
def x3(spark, d):
    return b.lines(spark, d).select("media_id", "line_no", t.clean_cjk_spaces(F.concat(F.lit("你 好 ,"), "text")).alias("text"))


@query("x5_clean_script")
def x5(spark, d):
    return b.dealt(b.table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", t.clean_script(F.col("text")).alias("text"))


@query("x6_sentences")
def x6(spark, d):
    return b.dealt(b.table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("n", "text"))


@query("x7_phrase_rules", "SELECT media_id, line_no, " + SQUEEZE.format("regexp_replace('Nên là ' || text || ' vì vậy.', '[ \\t\\n\\x0b\\f\\r]+([,.!?])', '\\1', 'g')") + " AS text FROM v_lines", V_LINES)
def x7(spark, d):
    return b.lines(spark, d).select("media_id", "line_no", t.spoken_style(F.concat(F.lit("Thành ra là  "), "text", F.lit(" do đó ."))).alias("text"))


@query("x16_language_codes", """SELECT doc_id, CASE lang WHEN 'en' THEN 'en|ch_sim+en' WHEN 'fr' THEN 'fr+en' WHEN 'de' THEN 'de+en' WHEN 'es' THEN 'es+en' ELSE 'ch_sim+en|ch_tra+en|en' END AS codes, lang AS iso FROM documents""")
def x16(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.array_join(lex.language_candidates(F.col("lang")), "|").alias("codes"), lex.iso_language(F.col("lang")).alias("iso"))


#: Labels of reader languages with what the second rule order gives.
LABELS = [("Tự động (auto)", "ch_sim|en"), ("Trung Giản Thể", "ch_sim|en"), ("Trung Phồn Thể", "ch_tra|en"), ("Tiếng Việt", "vi|en"), ("Tiếng Anh", "en"), ("Nhật", "ja|en"), ("en", "en"), ("fr", "fr|en"), ("de", "de|en"), ("es", "es|en"), ("?", "vi|en")]


@query("x16_reader_languages", "SELECT doc_id, list_extract([" + ", ".join(f"'{c}'" for _, c in LABELS) + "], CASE WHEN doc_id % 2 = 0 THEN coalesce(list_position(['en', 'fr', 'de', 'es'], lang) + 6, 11) ELSE CAST(doc_id % 11 + 1 AS INTEGER) END) AS codes FROM documents")
def x16b(spark, d):
    label = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.element_at(F.array(*[F.lit(x) for x, _ in LABELS]), (F.col("doc_id") % len(LABELS) + 1).cast("int")))
    return b.table(spark, d, "documents").select("doc_id", F.array_join(lex.reader_languages(label), "|").alias("codes"))


@query("o3_layered_union", "SELECT word AS key, first(source ORDER BY lang DESC, doc_id DESC, source DESC) AS value, first(lang ORDER BY lang DESC) AS layer FROM (SELECT unnest(string_split(text, ' ')) AS word, lang, doc_id, source FROM documents) u WHERE word <> '' GROUP BY word")
def o3(spark, d):
    """Words of the prose as entries of a layer a language, the later ones over the earlier."""
    layers = ["de", "en", "es", "fr"]
    w = b.table(spark, d, "documents").select("lang", "doc_id", "source", F.explode(F.split("text", " ")).alias("key"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, layers)), F.col("lang")), F.lit(0))
    return lex.merge_layers(w.select(F.col("lang").alias("layer"), rank.cast("int").alias("priority"), F.col("doc_id").alias("line_no"), "key", F.col("source").alias("value")))


@query("x17_strip_markup", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def x17(spark, d):
    return b.table(spark, d, "pages").select("page_id", t.strip_markup(F.col("html")).alias("text"))


@query("x18_word_wrap")
def x18(spark, d):
    return b.lines(spark, d).select("media_id", "line_no", F.posexplode(t.wrap_words(F.col("text"), 40)).alias("n", "row")).withColumn("overflow", F.length("row") > 40)


@query("x18_fit_text")
def x18b(spark, d):
    fit = t.fit_text(F.col("text"), 900, 200, 48, 12)
    return b.lines(spark, d).select("media_id", "line_no", fit.alias("f")).select("media_id", "line_no", "f.size", F.size("f.lines").alias("n_lines"), F.array_join("f.lines", "|").alias("lines"), "f.overflow")


@query("x19_numbered_lines", "SELECT media_id, line_no, regexp_replace(" + STRIPPED.format("text") + """, '^["''`]+|["''`]+$', '', 'g') AS text FROM v_lines""", V_LINES)
def x19(spark, d):
    from cuelake.operators.translate import clean_line

    return b.lines(spark, d).select("media_id", "line_no", clean_line(F.concat(F.lit("Dòng 3: "), "text")).alias("text"))
