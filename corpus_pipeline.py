"""From documents to token ids: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All stages but the last return the columns of
`documents`, whatever others docs has.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import bpe, line_dedup, minhash, mixing, quality
from cuelake.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the likelihood-ratio threshold."""
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_rules(docs.select(COLUMNS), trusted).filter("kept").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a smaller doc_id holds; n_chars follows the text."""
    return line_dedup.dedup_lines(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (similarity 0.8), that with the smallest doc_id.

    Rows without doc_id stay.
    """
    gone = minhash.near_duplicates(docs, percent=80).filter("NOT kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone.hint("merge"), "doc_id", "left_anti").select(COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: the files, read in the order of their
    part numbers, hold every source within one block of its target share."""
    mixed = mixing.mix_sources(docs.select(COLUMNS))
    order = [F.col("slot").asc_nulls_last(), F.col("pos"), F.col("source"), F.col("source_rank")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with its place in the mixture, and the digests of ids and
    of the decoded bytes.

    Places depend on the documents alone, not on the order in which they are read, so they
    are those of mix_stage: (slot, pos) orders the rows as the mixture does.
    """
    import public_tokenizers

    mixed = staged(mixing.mix_sources(docs.select(COLUMNS)), "placed")  # short and long texts read it
    found = bpe.encode_decode(mixed, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True, carry=("source", "slot", "pos"))
    return found.select("doc_id", "source", "slot", "pos", "n_tokens", "ids", F.sha2("ids_csv", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources", mix_stage),
    ("byte-level BPE", token_stage),
]

#: Hashed likelihood ratios, sketches and BPE are beyond SQL: tests/llm/test_pipeline.py holds
#: run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
