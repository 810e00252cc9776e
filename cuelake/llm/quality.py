"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import WS, WS_CHARS, words

#: Buckets of the two multinomials: with unigrams and bigrams of word and mark runs.
BUCKETS = 10_000
#: Trusted rows that the target multinomial is fitted on, at most.
MAX_TRUSTED = 20_000
#: Mean log-likelihood ratio in nats a document must reach.
THRESHOLD = -0.25
WINDOW = 8
#: Ratios are stored as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
#: Runs of letters, digits and non-ASCII characters, or of ASCII marks.
TOKEN = r"[A-Za-z0-9\u0080-\x{10FFFF}]+|[!-/:-@\[-`{-~]+"


def token_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits and of the runs of ASCII marks."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)
    return F.transform(tokens, lambda t: F.xxhash64(t))


def gram_buckets(hashes: Column, buckets: int) -> Column:
    """Bucket of every unigram and bigram of an array of token hashes."""
    return F.concat(
        F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")),
        F.transform(
            F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
            lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(buckets)).cast("int"),
        ),
    )


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """At most `limit` ids labelled good and not toxic, those with the smallest hashes."""
    good = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit_ratio(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """One row, one array `llr`: ln(p_target / p_raw) of each bucket in millionths.

    Raw counts cover every token of every document; target counts those of the
    documents in `trusted` (bounded, hence broadcast). Both get one count a bucket.
    """
    mark = trusted.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_in"))
    grams = docs.join(F.broadcast(mark), F.col("doc_id") == F.col("_id"), "left").select(
        F.coalesce("_in", F.lit(False)).alias("_in"), token_hashes(F.col("text")).alias("_h")
    ).select("_in", F.explode(gram_buckets(F.col("_h"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("_in").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    table = every.join(F.broadcast(counts), "bucket", "left").select(
        "bucket", (F.coalesce("raw", F.lit(0)) + 1).alias("raw"), (F.coalesce("target", F.lit(0)) + 1).alias("target")
    )
    one = table.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("t"), F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    llr = F.transform("t", lambda x: F.round((F.log(x["target"] / F.col("all_target")) - F.log(x["raw"] / F.col("all_raw"))) * UNIT).cast("long"))
    return one.select(llr.alias("llr"))


def ratio_score(hashes: Column, llr: Column, buckets: int) -> Column:
    """Mean of llr over the unigrams and bigrams of token hashes; 0.0 without tokens."""
    total = lambda grams: F.aggregate(grams, F.lit(0).cast("long"), lambda s, b: s + F.get(llr, b))
    return F.when(F.size(hashes) == 0, F.lit(0.0)).otherwise(
        total(gram_buckets(hashes, buckets)) / (2 * F.size(hashes) - 1) / UNIT
    )


def repeated_words(hashes: Column, n: int) -> Column:
    """Words inside an n-word window that occurs at least twice, from word hashes.

    Windows are sorted by hash with their positions, neighbours with equal hashes are
    repeated, and a fold over their ascending positions adds up what they cover.
    """
    at = lambda i, k: F.get(hashes, i + k)
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(hashes) - n, F.lit(0))),
        lambda i: F.xxhash64(*[at(i, k) for k in range(n)]),
    )
    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.aggregate(
            F.sort_array(
                F.flatten(
                    F.transform(
                        F.array(pairs),
                        lambda p: F.transform(
                            F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"])),
                            lambda x: x["i"],
                        ),
                    )
                )
            ),
            F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n")),
            lambda s, i: F.struct((i + n).alias("end"), (s["n"] + (i + n - F.greatest(s["end"], i))).cast("long").alias("n")),
            lambda s: s["n"],
        )
    # array(windows) and max() keep one evaluation of the windows for both uses
    counted = F.transform(
        F.array(windows),
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)),
    )
    return F.when(F.size(hashes) <= n, F.lit(0).cast("long")).otherwise(F.get(counted, F.lit(0)))


def quality_rules(docs: DataFrame, trusted: DataFrame, *, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Adds counts, the likelihood-ratio score and the verdict to every document.

    Words are runs of characters outside [\\x20\\x09-\\x0D]; a null text has none.
    n_words, word_chars, n_symbols (#*$%&|<>), n_dup_lines (lines with a word, equal to
    an earlier line), n_repeat_words (words in 8-word windows found twice or more);
    base_failed: fewer than 20 words, or over 30 % repeat words; score: mean of
    ln(p_target / p_raw) over the hashed unigrams and bigrams of the text; kept: not
    base_failed and score >= threshold.

    `trusted` holds at most MAX_TRUSTED ids (see trusted_ids); with none of them in
    `docs` both multinomials are smoothed from the raw counts against a flat target.
    Every row is kept, with nulls, repeated ids and extra columns as they are; input
    columns with the names above are replaced. An empty table gives an empty table.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    docs = docs.drop(*names)
    llr = fit_ratio(docs.select("doc_id", "text"), trusted, buckets=buckets).scalar()
    text = F.coalesce("text", F.lit(""))
    # Nondeterministic to the optimiser, so that a filter on a count stays above the counts:
    # pushed below, it would take the hashes of the whole text into each of its windows.
    once = lambda c: F.when(F.spark_partition_id() >= 0, c)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WS_CHARS)) != "")
    return (
        docs.withColumns({
            "_w": F.transform(words(F.col("text")), lambda w: F.xxhash64(w)),
            "_t": token_hashes(F.col("text")),
            "_l": lines,
        })
        .withColumn("_llr", llr)  # of one use: the projection below takes the subquery in
        .withColumns({
            "n_words": once(F.size("_w").cast("long")),
            "word_chars": once((F.length(text) - F.regexp_count(text, F.lit(WS))).cast("long")),
            "n_symbols": once(F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")),
            "n_dup_lines": once((F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")),
            "n_repeat_words": once(repeated_words(F.col("_w"), WINDOW)),
            "score": once(ratio_score(F.col("_t"), F.col("_llr"), buckets)),
        })
        .drop("_w", "_t", "_l", "_llr")
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, trusted_ids(labels)).drop("text")
