"""Translation as tables: memory, batches, requests, answers and fallback."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions.text import spoken_style, squeeze, strip
from cuelake.operators.keyed import KeyedTable
from cuelake.operators.lexicon import enforce_words, translate_longest
from cuelake.operators.resume import folded
from cuelake.operators.shared import written

MEMORY_KEY = ["src", "tgt", "engine", "text"]
#: Lines of a request by provider (fixed values).
BATCH_SIZES = {"batch": 5, "draft": 12, "free": 15, "bulk": 50}


def lookup_memory(cues: DataFrame, memory: DataFrame) -> DataFrame:
    """Adds hit: the remembered translation (MEMORY_KEY, value), if not blank and not the text."""
    m = memory.filter((strip(F.coalesce("value", F.lit(""))) != "") & (F.col("value") != F.col("text"))).dropDuplicates(MEMORY_KEY)
    return cues.join(m.select(*MEMORY_KEY, F.col("value").alias("hit")), MEMORY_KEY, "left")


def residue(cues: DataFrame, memory: DataFrame) -> DataFrame:
    """Distinct keys without a valid hit: what has to be requested."""
    m = memory.filter((strip(F.coalesce("value", F.lit(""))) != "") & (F.col("value") != F.col("text")))
    return cues.select(MEMORY_KEY).dropDuplicates().join(m, MEMORY_KEY, "left_anti")


def valid_answers(answers: DataFrame) -> DataFrame:
    """Answers (MEMORY_KEY, value) to remember: not blank and not the text itself; of several the smallest."""
    new = answers.filter((strip(F.coalesce("value", F.lit(""))) != "") & (F.col("value") != F.col("text")))
    return new.groupBy(MEMORY_KEY).agg(F.min("value").alias("value"))


def write_back(memory: DataFrame, answers: DataFrame) -> DataFrame:
    """Memory with the valid answers (MEMORY_KEY, value) in place of older values."""
    new = valid_answers(answers)
    return memory.join(new.hint("merge"), MEMORY_KEY, "left_anti").unionByName(new)


def remember(memory: KeyedTable, answers: DataFrame) -> None:
    """The same in place, in a memory kept as a table by MEMORY_KEY: only the buckets of the answers are rewritten."""
    memory.upsert(valid_answers(answers))


def refine_key(engine: Column, glossary: Column, original: Column, raw: Column) -> Column:
    """Key of a refinement: engine, the glossary map in the order of its keys, both texts."""
    entries = F.array_sort(F.map_entries(glossary))
    return F.sha2(F.to_json(F.struct(engine.alias("engine"), entries.alias("glossary"), original.alias("original"), raw.alias("raw"))), 256)


def fixed_batches(lines: DataFrame, size: int) -> DataFrame:
    """Adds batch and pos: `size` lines (media_id, ord) a batch."""
    n = F.row_number().over(W.partitionBy("media_id").orderBy("ord")) - 1
    return lines.withColumns({"batch": F.floor(n / size).cast("bigint"), "pos": (n % size).cast("int")})


def _breaks(sizes: np.ndarray, budget: int, open_chars: int) -> tuple[list[int], int]:
    """(lines that begin a batch, characters of the last batch), given those of the batch that is open before.

    The next break is a search in the running sums, so that the steps are as many as the batches.
    """
    sums, at, taken, found = np.cumsum(sizes), 0, 0, []
    while True:
        k = int(np.searchsorted(sums, budget - open_chars + taken, "right"))
        k = max(k, at)
        if k >= len(sums):
            return found, open_chars + int(sums[-1]) - taken if len(sums) else open_chars
        if open_chars + int(sums[k]) - int(sizes[k]) - taken > 0:
            found.append(k)
        at, taken, open_chars = k + 1, int(sums[k]), int(sizes[k])


def budget_batches(lines: DataFrame, budget: int = 2_500, *, piece_bits: int | None = None) -> DataFrame:
    """(media_id, ord, batch): a batch is closed before the line that would take a non-empty
    one over the budget. A null text has no characters.

    A medium of any size is cut into pieces (see resume.folded): where a batch begins, what was before
    is forgotten. Pieces number their own batches; a running sum of their numbers puts them in line.
    """

    def fold(table: pa.Table, state: bytes | None) -> tuple[pa.Table, bytes]:
        sizes = table["n"].to_numpy()
        found, chars = _breaks(sizes, budget, int(state or 0))
        local = np.zeros(len(sizes), np.int64)
        local[found] = 1
        return pa.table({"media_id": table["media_id"], "ord": table["ord"], "local": np.cumsum(local)}), str(chars).encode()

    sized = lines.select("media_id", F.col("ord").cast("bigint").alias("ord"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"))
    kind = lines.schema["media_id"].dataType.simpleString()
    rows = written(folded(sized, ["media_id"], ["ord"], fold, f"media_id {kind}, ord bigint, local bigint", piece_bits=piece_bits), "batches")
    runs = rows.groupBy("media_id", "_piece").agg(F.max("local").alias("breaks"))
    earlier = W.partitionBy("media_id").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.sum("breaks").over(earlier)).filter("before > 0").select("media_id", "_piece", "before")
    joined = rows.join(runs.hint("merge"), ["media_id", "_piece"], "left")
    return joined.select("media_id", "ord", (F.coalesce("before", F.lit(0)) + F.col("local")).cast("int").alias("batch"))


def requests(batched: DataFrame, *, form: str = "numbered", template: str = "{text}", delimiter: str = "\n|||\n") -> DataFrame:
    """(media_id, batch, n, payload): numbered lines with draft hints, a JSON array of
    {id, src, draft}, delimited texts, or a template around the texts."""
    has_draft = "draft" in batched.columns
    draft = F.col("draft") if has_draft else F.lit(None).cast("string")
    rows = batched.groupBy("media_id", "batch").agg(F.array_sort(F.collect_list(F.struct("pos", "text", draft.alias("draft")))).alias("l"))
    hint = lambda x: F.when(x["draft"].isNotNull(), F.concat(F.lit(" (draft: "), x["draft"], F.lit(")"))).otherwise(F.lit(""))
    if form == "numbered":
        payload = F.array_join(F.transform("l", lambda x: F.concat((x["pos"] + 1).cast("string"), F.lit(". "), x["text"], hint(x))), "\n")
    elif form == "json":
        payload = F.to_json(F.transform("l", lambda x: F.struct((x["pos"] + 1).alias("id"), x["text"].alias("src"), x["draft"].alias("draft"))))
    else:
        payload = F.array_join(F.col("l.text"), delimiter)
        if form == "template":
            payload = F.replace(F.lit(template), F.lit("{text}"), payload)
    return rows.select("media_id", "batch", F.size("l").alias("n"), payload.alias("payload"))


def clean_line(line: Column) -> Column:
    """A line of an answer without `Dòng 1:` or `1.` before it and quotes around it."""
    x = F.regexp_replace(strip(line), r"(?iu)^(?:dòng\s*)?\d+\s*[:.)]\s*", "")
    return F.regexp_replace(x, "^[\"'`]+|[\"'`]+$", "")


def align_answers(answers: DataFrame, delimiter: str = "|||") -> DataFrame:
    """(media_id, batch, pos, text) of answers (media_id, batch, n, raw): fences stripped; the
    non-blank lines if they are n, else the delimited parts if they are n, else no row."""
    bare = F.regexp_replace("raw", r"(?m)^```\w*\s*$", "")
    full = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")
    lines, parts = full(F.split(bare, "\n")), full(F.split(bare, rf"\Q{delimiter}\E"))
    chosen = F.when(F.size(lines) == F.col("n"), lines).when(F.size(parts) == F.col("n"), parts)
    return answers.select("media_id", "batch", F.posexplode(chosen).alias("pos", "text"))


def json_answers(answers: DataFrame) -> DataFrame:
    """(media_id, batch, pos, text) of answers that hold a JSON array: strings, as many as
    asked for, or {id, text} with 1 <= id <= n; others are ignored."""
    found = F.regexp_extract("raw", r"(?s)\[.*\]", 0)
    texts, items = F.from_json(found, "array<string>"), F.from_json(found, "array<struct<id:int,text:string>>")
    addressed = found.rlike(r"^\[\s*\{")
    a = answers.select("media_id", "batch", "n", texts.alias("texts"), items.alias("items"), addressed.alias("addressed"))
    plain = a.filter(~F.col("addressed") & (F.size("texts") == F.col("n"))).select("media_id", "batch", F.posexplode("texts").alias("pos", "text"))
    by_id = a.filter("addressed").select("media_id", "batch", "n", F.inline("items")).filter("id BETWEEN 1 AND n").groupBy("media_id", "batch", (F.col("id") - 1).alias("pos")).agg(F.max("text").alias("text"))
    return plain.unionByName(by_id)


def attach(batched: DataFrame, aligned: DataFrame) -> DataFrame:
    """Batched lines with `out`, the aligned text of their position, or their own text."""
    x = aligned.withColumnRenamed("text", "_new")
    return batched.join(x.hint("merge"), ["media_id", "batch", "pos"], "left").withColumn("out", F.coalesce("_new", "text")).drop("_new")


def tiered(batched: DataFrame, answers: DataFrame) -> DataFrame:
    """Lines with the text of the lowest tier that answered every line of their batch.

    answers: (media_id, batch, tier, pos, text). A tier counts if it has exactly one
    non-blank text for each line; without one the line keeps its text (tier null).
    """
    size = batched.groupBy("media_id", "batch").agg(F.count("*").alias("size"))
    good = (strip(F.coalesce("text", F.lit(""))) != "").alias("good")
    per = answers.select("media_id", "batch", "tier", "pos", good).groupBy("media_id", "batch", "tier").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.bool_and("good").alias("ok"))
    chosen = per.join(size.hint("merge"), ["media_id", "batch"]).filter("ok AND n = size AND d = size").groupBy("media_id", "batch").agg(F.min("tier").alias("tier"))
    texts = answers.join(chosen.hint("merge"), ["media_id", "batch", "tier"]).select("media_id", "batch", "pos", "tier", F.col("text").alias("_new"))
    return batched.join(texts.hint("merge"), ["media_id", "batch", "pos"], "left").withColumn("out", F.coalesce("_new", "text")).drop("_new")


def breaker(calls: DataFrame, limit: int = 3) -> DataFrame:
    """Adds skipped to calls (job_id, event_id, ok): tier 1 is left out for good once `limit`
    calls in a row have failed."""
    w = W.partitionBy("job_id").orderBy("event_id")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    n = F.row_number().over(w)
    c = calls.withColumn("_n", n).withColumn("_run", F.col("_n") - F.coalesce(F.max(F.when(F.col("ok"), F.col("_n"))).over(so_far), F.lit(0)))
    tripped = F.max((F.col("_run") >= limit).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return c.withColumn("skipped", F.coalesce(tripped, F.lit(0)) == 1).drop("_n", "_run")


def keep_overrides(cues: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Cues (text, machine, manual_override): overridden ones keep their text, others take the
    machine's, with proper names capitalised; raw_text is always the machine's."""
    if names is not None:
        known = enforce_words(cues.select(F.col("machine").alias("text")).distinct(), names, longest_first=True).select(F.col("text").alias("machine"), F.col("out").alias("_m"))
        cues = cues.join(known, "machine", "left")
    else:
        cues = cues.withColumn("_m", F.col("machine"))
    over = F.coalesce("manual_override", F.lit(False))
    return cues.withColumn("raw_text", F.col("machine")).withColumn("text", F.when(over, F.col("text")).otherwise(F.coalesce("_m", "text"))).drop("_m")


def compare(raw: DataFrame, translated: DataFrame) -> DataFrame:
    """Cues that one side lacks or whose times differ, by ordinal: no rows means no drift."""
    side = lambda df, p: df.select("media_id", "ord", F.col("start_ms").alias(f"{p}_start"), F.col("end_ms").alias(f"{p}_end"))
    j = side(raw, "raw").join(side(translated, "out"), ["media_id", "ord"], "full")
    same = F.floor(F.col("raw_start") / 10).eqNullSafe(F.floor(F.col("out_start") / 10)) & F.floor(F.col("raw_end") / 10).eqNullSafe(F.floor(F.col("out_end") / 10))
    return j.filter(~same)


def draft_and_refine(cues: DataFrame, memory: DataFrame, lexicon: DataFrame, refined: DataFrame, size: int = BATCH_SIZES["draft"]) -> DataFrame:
    """Cues (media_id, ord, text, src, tgt, engine) with out: the remembered text, else the
    refined draft by id in its batch, else the draft in spoken style.

    refined: answers (media_id, batch, n, raw). A parsed answer leaves lines it does not
    name as they are; memory is keyed by the original text.
    """
    looked = lookup_memory(cues, memory)
    open_lines = fixed_batches(looked.filter("hit IS NULL").drop("hit"), size)
    drafts = translate_longest(open_lines.select("text").distinct(), lexicon).select("text", F.col("out").alias("draft"))
    lines = open_lines.join(drafts.hint("merge"), "text", "left")
    answers = json_answers(refined).withColumnRenamed("text", "_new")
    parsed = answers.select("media_id", "batch").distinct().withColumn("_parsed", F.lit(True))
    done = lines.join(answers.hint("merge"), ["media_id", "batch", "pos"], "left").join(parsed.hint("merge"), ["media_id", "batch"], "left")
    out = F.coalesce("_new", F.when(F.col("_parsed"), F.col("text")), spoken_style(F.col("draft")))
    kept = [c for c in cues.columns]
    return looked.filter("hit IS NOT NULL").withColumn("out", F.col("hit")).select(*kept, "out").unionByName(done.withColumn("out", out).select(*kept, "out"))


def translate_set(cues: DataFrame, answers: DataFrame, lexicon: DataFrame, size: int = BATCH_SIZES["free"]) -> DataFrame:
    """Cues translated with the same count and times: the aligned answer (media_id, batch, n,
    raw) of their batch, else the dictionary; see compare() for the post-condition."""
    batched = fixed_batches(cues, size)
    aligned = align_answers(answers).withColumnRenamed("text", "_new")
    j = batched.join(aligned.hint("merge"), ["media_id", "batch", "pos"], "left")
    fallback = translate_longest(j.filter("_new IS NULL").select("text").distinct(), lexicon).select("text", F.col("out").alias("_f"))
    return j.join(fallback.hint("merge"), "text", "left").withColumn("out", squeeze(F.coalesce("_new", "_f"))).select(*cues.columns, "out")
