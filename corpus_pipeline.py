"""A training-data pipeline of the operators in ``equigauge.llm``.

Quality classifier, near-duplicates, pseudonyms, mix of sources, BPE encoding. Every stage takes
(spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the last
return the columns of documents. ``run`` writes what a stage returns to the shared folder and
reads it again for the next.

The near-duplicate stage judges rows, so ids may repeat or be null. The mix repeats documents, so
their ids repeat from there on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equigauge.llm import bpe, dedup, mixing, pii, quality
from equigauge.llm.common import prepare, read_table, staged

TOKENIZER = "byte_bpe_50k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    labelled = quality.training_rows(docs, read_table(spark, sf_dir, "labels"))
    name = _free_name(docs, "_row_score")
    scored = quality.with_score(docs, labelled, name)
    return scored.filter(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def _free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def row_key(doc_id: Column, text: Column) -> Column:
    """A text that sorts by doc_id (null last), then tells rows of one id apart by their texts."""
    # Hexadecimal digits sort like the numbers once the sign bit is turned.
    number = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(number, F.lit("null")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest doc_id, null last.

    Rows are judged and dropped one by one, whatever ids they share. Of rows with the same id and
    text one stays.
    """
    prepare(spark)
    name = _free_name(docs, "_row_key")
    keyed = docs.withColumn(name, row_key(F.col("doc_id"), F.col("text")))
    judged = dedup.near_duplicates(keyed.select(F.col(name).alias("doc_id"), "text"))
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    left = keyed.join(gone, name, "left_anti")
    # Rows that are repeated whole have one key; there are few keys of more than one row, mostly none.
    repeated = staged(
        keyed.groupBy(name).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(name), "repeated-keys"
    )
    single = left.join(repeated, name, "left_anti")
    again = left.join(repeated, name, "left_semi").dropDuplicates([name])
    return single.unionByName(again).select(*docs.columns)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms."""
    prepare(spark)
    new = pii.pseudonymise(docs)
    if "n_chars" not in docs.columns:
        return new
    kind = dict(docs.dtypes)["n_chars"]
    return new.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by their weights, repetitions as rows."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, counted and digested, with the digest of what they decode to."""
    prepare(spark)
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pseudonyms", pseudonym_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

#: No stage but the mix can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
