"""Queries over translation tables, with their SQL."""
from pyspark.sql import functions as F

from cuelake.operators import translate as tr
from cuelake.operators.keyed import KeyedTable
from cuelake.operators.shared import new_path
from cuelake.plans import bindings as b
from cuelake.plans.bindings import V_JOBS
from cuelake.plans.registry import query

CUES = "tc AS (SELECT conv_id AS media_id, turn AS ord, text, 'en' AS src, 'vi' AS tgt, role AS engine FROM conversations)"
MEMORY = "mem AS (SELECT src, tgt, engine, text, CASE WHEN min(media_id) % 5 = 0 THEN ' ' WHEN min(media_id) % 5 = 1 THEN text ELSE 'T:' || text END AS value FROM tc WHERE media_id % 3 <> 0 GROUP BY src, tgt, engine, text)"
BATCHES = "bt AS (SELECT *, n // 5 AS batch, CAST(n % 5 AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY ord) - 1 AS n FROM tc) q)"
VALID = "ok AS (SELECT * FROM mem WHERE trim(value) <> '' AND value <> text)"


def cues(spark, d):
    return b.turns(spark, d).select(F.col("conv_id").alias("media_id"), F.col("turn").alias("ord"), "text", F.lit("en").alias("src"), F.lit("vi").alias("tgt"), F.col("role").alias("engine"))


def memory(spark, d):
    m = F.min("media_id") % 5
    return cues(spark, d).filter("media_id % 3 <> 0").groupBy("src", "tgt", "engine", "text").agg(F.when(m == 0, F.lit(" ")).when(m == 1, F.col("text")).otherwise(F.concat(F.lit("T:"), "text")).alias("value"))


@query("j2_memory_lookup", "SELECT tc.*, ok.value AS hit FROM tc LEFT JOIN ok USING (src, tgt, engine, text)", CUES, MEMORY, VALID)
def j2(spark, d):
    return tr.lookup_memory(cues(spark, d), memory(spark, d))


@query("j3_uncached_residue", "SELECT DISTINCT src, tgt, engine, text FROM tc WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.src = tc.src AND ok.tgt = tc.tgt AND ok.engine = tc.engine AND ok.text = tc.text)", CUES, MEMORY, VALID)
def j3(spark, d):
    return tr.residue(cues(spark, d), memory(spark, d))


@query("b1_requests_after_dedupe", "SELECT engine, count(*) AS lines, count(DISTINCT tc.text) AS texts, count(DISTINCT tc.text) FILTER (ok.value IS NULL) AS to_request FROM tc LEFT JOIN ok USING (src, tgt, engine, text) GROUP BY engine", CUES, MEMORY, VALID)
def b1(spark, d):
    n = cues(spark, d).groupBy("engine").agg(F.count("*").alias("lines"), F.count_distinct("text").alias("texts"))
    left = tr.residue(cues(spark, d), memory(spark, d)).groupBy("engine").agg(F.count("*").alias("to_request"))
    return n.join(left, "engine", "left").na.fill(0, ["to_request"])


WRITTEN_BACK = """, nw AS (SELECT src, tgt, engine, text, min(CASE WHEN media_id % 2 = 0 THEN 'N:' || text ELSE text END) FILTER (media_id % 2 = 0) AS value FROM tc GROUP BY 1, 2, 3, 4), nv AS (SELECT * FROM nw WHERE value IS NOT NULL)
 SELECT * FROM nv UNION ALL SELECT m.src, m.tgt, m.engine, m.text, m.value FROM mem m ANTI JOIN nv USING (src, tgt, engine, text)""".replace(", nw", "WITH nw", 1)


def given_answers(spark, d):
    return cues(spark, d).withColumn("value", F.when(F.col("media_id") % 2 == 0, F.concat(F.lit("N:"), "text")).otherwise(F.col("text"))).select(*tr.MEMORY_KEY, "value")


@query("b2_write_back", WRITTEN_BACK, CUES, MEMORY)
def b2(spark, d):
    return tr.write_back(memory(spark, d), given_answers(spark, d))


@query("b2_memory_table", WRITTEN_BACK, CUES, MEMORY)
def b2_table(spark, d):
    """The memory as a table that is changed in place."""
    table = KeyedTable.create(memory(spark, d), new_path(spark, "memory"), *tr.MEMORY_KEY)
    tr.remember(table, given_answers(spark, d))
    return table.read(spark)


@query("b3_refine_key", """SELECT conv_id, turn, sha256('{"engine":"' || role || '","glossary":[{"key":"a","value":"1"},{"key":"b","value":"2"}],"original":"o' || turn || '","raw":"r"}') AS key FROM conversations""")
def b3(spark, d):
    g = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    return b.turns(spark, d).select("conv_id", "turn", tr.refine_key(F.col("role"), g, F.concat(F.lit("o"), F.col("turn").cast("string")), F.lit("r")).alias("key"))


@query("b4_fixed_batches", "SELECT media_id, ord, batch, pos FROM bt", CUES, BATCHES)
def b4(spark, d):
    return tr.fixed_batches(cues(spark, d), 5).select("media_id", "ord", "batch", "pos")


@query("b5_budget_batches", """RECURSIVE WITH l AS (SELECT doc_id AS media_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents),
 f AS (SELECT media_id, ord, length(text) AS chars, 0 AS batch FROM l WHERE ord = 0
 UNION ALL SELECT l.media_id, l.ord, CASE WHEN f.chars + length(l.text) > 2500 AND f.chars > 0 THEN length(l.text) ELSE f.chars + length(l.text) END, CASE WHEN f.chars + length(l.text) > 2500 AND f.chars > 0 THEN f.batch + 1 ELSE f.batch END FROM f JOIN l ON l.media_id = f.media_id AND l.ord = f.ord + 1)
 SELECT media_id, ord, batch FROM f""", CUES)
def b5(spark, d):
    return tr.budget_batches(b.lines(spark, d).select("media_id", F.col("line_no").alias("ord"), "text"))


@query("b6_numbered_request", "SELECT media_id, batch, count(*)::INTEGER AS n, string_agg((pos + 1)::VARCHAR || '. ' || text, chr(10) ORDER BY pos) AS payload FROM bt GROUP BY 1, 2", CUES, BATCHES)
def b6(spark, d):
    return tr.requests(tr.fixed_batches(cues(spark, d), 5))


@query("b6_delimited_request", "SELECT media_id, batch, count(*)::INTEGER AS n, '<' || string_agg(text, chr(10) || '|||' || chr(10) ORDER BY pos) || '>' AS payload FROM bt GROUP BY 1, 2", CUES, BATCHES)
def b6b(spark, d):
    return tr.requests(tr.fixed_batches(cues(spark, d), 5), form="template", template="<{text}>")


ANSWERS = "an AS (SELECT media_id, batch, n, CASE batch % 3 WHEN 0 THEN '```' || chr(10) || a || chr(10) || '```' WHEN 1 THEN replace(a, chr(10), '|||') ELSE a || chr(10) || 'extra' END AS raw FROM (SELECT media_id, batch, count(*)::INTEGER AS n, string_agg('t' || pos || replace(text, chr(10), ' '), chr(10) ORDER BY pos) AS a FROM bt GROUP BY 1, 2) q)"


def answers(spark, d, size=5):
    t = tr.fixed_batches(cues(spark, d), size).withColumn("text", F.concat(F.lit("t"), F.col("pos").cast("string"), F.replace("text", F.lit("\n"), F.lit(" "))))
    r = tr.requests(t, form="delimited", delimiter="\n")
    a = F.col("payload")
    raw = F.when(F.col("batch") % 3 == 0, F.concat(F.lit("```\n"), a, F.lit("\n```"))).when(F.col("batch") % 3 == 1, F.replace(a, F.lit("\n"), F.lit("|||"))).otherwise(F.concat(a, F.lit("\nextra")))
    return r.select("media_id", "batch", "n", raw.alias("raw"))


ALIGNED = "al AS (SELECT media_id, batch, pos, trim('t' || pos || replace(text, chr(10), ' ')) AS text FROM bt WHERE batch % 3 <> 2)"


@query("b7_align_answers", "SELECT * FROM al", CUES, BATCHES, ALIGNED)
def b7(spark, d):
    return tr.align_answers(answers(spark, d))


@query("j6_positional_attach", "SELECT bt.media_id, bt.ord, coalesce(al.text, bt.text) AS out FROM bt LEFT JOIN al USING (media_id, batch, pos)", CUES, BATCHES, ALIGNED)
def j6(spark, d):
    return tr.attach(tr.fixed_batches(cues(spark, d), 5), tr.align_answers(answers(spark, d))).select("media_id", "ord", "out")


def id_answers(spark, d):
    r = tr.fixed_batches(cues(spark, d), 5).withColumns({"id": F.col("pos") + 1 + F.when(F.col("pos") == 3, 40).otherwise(0)})
    item = F.struct("id", F.concat(F.lit("#"), F.col("ord").cast("string")).alias("text"))
    return r.groupBy("media_id", "batch").agg(F.count("*").cast("int").alias("n"), F.concat(F.lit("Here: "), F.to_json(F.array_sort(F.collect_list(item))), F.lit(" done")).alias("raw"))


@query("j7_id_attach", "SELECT media_id, ord, CASE WHEN pos = 3 THEN text ELSE '#' || ord END AS out FROM bt", CUES, BATCHES)
def j7(spark, d):
    return tr.attach(tr.fixed_batches(cues(spark, d), 5), tr.json_answers(id_answers(spark, d))).select("media_id", "ord", "out")


@query("b8_json_answers", "SELECT media_id, batch, pos, '#' || ord AS text FROM bt WHERE pos <> 3", CUES, BATCHES)
def b8(spark, d):
    return tr.json_answers(id_answers(spark, d))


@query("b9_tiered_fallback", """, a AS (SELECT media_id, batch, tier, pos, CASE WHEN (ord + tier) % 7 = 0 THEN ' ' ELSE tier || text END AS text FROM bt, (VALUES (1), (2), (3)) v(tier)),
 p AS (SELECT media_id, batch, tier, bool_and(trim(text) <> '') AS ok FROM a GROUP BY 1, 2, 3), c AS (SELECT media_id, batch, min(tier) AS tier FROM p WHERE ok GROUP BY 1, 2)
 SELECT bt.media_id, bt.ord, c.tier, CASE WHEN c.tier IS NULL THEN bt.text ELSE c.tier || bt.text END AS out FROM bt LEFT JOIN c USING (media_id, batch)""".replace(", a AS", "WITH a AS", 1), CUES, BATCHES)
def b9(spark, d):
    bt = tr.fixed_batches(cues(spark, d), 5)
    a = bt.withColumn("tier", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("text", F.when((F.col("ord") + F.col("tier")) % 7 == 0, F.lit(" ")).otherwise(F.concat(F.col("tier").cast("string"), "text")))
    return tr.tiered(bt, a.select("media_id", "batch", "tier", "pos", "text")).select("media_id", "ord", "tier", "out")


@query("b10_manual_override", "SELECT media_id, ord, CASE WHEN ord % 2 = 0 THEN text ELSE 'M' || engine END AS text, 'M' || engine AS raw_text FROM tc", CUES)
def b10(spark, d):
    c = cues(spark, d).withColumns({"machine": F.concat(F.lit("m"), "engine"), "manual_override": F.col("ord") % 2 == 0})
    names = c.select("machine").distinct().select(F.lit(0).alias("ord"), F.col("machine").alias("key"), F.initcap("machine").alias("value"))
    out = tr.keep_overrides(c, names).select("media_id", "ord", "text", F.initcap("raw_text").alias("raw_text"))
    return out


@query("b11_draft_and_refine")
def b11(spark, d):
    lexicon = b.pairs(spark).select("key", "value")
    return tr.draft_and_refine(cues(spark, d), memory(spark, d), lexicon, id_answers(spark, d).filter("media_id % 2 = 0")).select("media_id", "ord", "out")


@query("b12_translate_set")
def b12(spark, d):
    lexicon = b.pairs(spark).select("key", "value")
    return tr.translate_set(cues(spark, d), answers(spark, d, 15), lexicon).select("media_id", "ord", "out")


@query("j8_compare_tracks", "SELECT a.media_id, a.ord, a.start_ms AS raw_start, a.end_ms AS raw_end, CASE WHEN a.ord % 10 <> 0 THEN a.start_ms + a.ord % 3 * 10 END AS out_start, CASE WHEN a.ord % 10 <> 0 THEN a.end_ms END AS out_end FROM v_cues a WHERE a.ord % 10 = 0 OR a.ord % 3 > 0", b.V_CUES)
def j8(spark, d):
    raw = b.cues(spark, d)
    out = raw.filter("ord % 10 <> 0").withColumn("start_ms", F.col("start_ms") + F.col("ord") % 3 * 10)
    return tr.compare(raw, out)


@query("w7_breaker", """, n AS (SELECT job_id, event_id, event_id % 5 > 1 AS ok, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS n FROM v_jobs),
 r AS (SELECT *, n - coalesce(max(CASE WHEN ok THEN n END) OVER (PARTITION BY job_id ORDER BY event_id), 0) AS run FROM n)
 SELECT job_id, event_id, coalesce(max(CASE WHEN run >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skipped FROM r""".replace(", n AS", "WITH n AS", 1), b.V_CUES, V_JOBS)
def w7(spark, d):
    calls = b.job_events(spark, d).select("job_id", "event_id", (F.col("event_id") % 5 > 1).alias("ok"))
    return tr.breaker(calls, 2).select("job_id", "event_id", "skipped")
