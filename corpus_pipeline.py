"""The corpus pipeline: five filtering and encoding stages over documents, each reading what the one before it kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Each row is judged by itself, whatever its
doc_id: operators pass rows on beside their verdicts, or take a key of the whole row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import decontaminate, jaccard, lattice, pii, toxicity
from tidegraph.llm.common import delete, scratch, shared_dir, table
from tidegraph.llm.queries import model_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below its threshold, each row by its own text. Null and empty texts have the score of a text
    without evidence and stay; repeated rows stay or go together; an empty table gives no rows; further columns are left out."""
    docs = docs.select(*COLUMNS)
    crf = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, crf, whole=True).where("predicted = 0").select("row.*")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the smallest doc_id (null ids last); rows that link with nothing all stay.

    Rows go through the operator by a hash of all their columns, not by doc_id: equal keys are equal rows (of n distinct rows n^2/2^65
    pairs are expected to share a key), and a component's least key names it. Rows without words have no copies, equal rows included."""
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)).alias("row_key"))
    members = jaccard.cluster(keyed, "row_key").groupBy("row_key").agg(F.max("n_shingles").alias("n"), F.min("component_id").alias("component"))
    members = members.where("n > 0").join(keyed.select("row_key", "doc_id").distinct(), "row_key")
    best = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("best")).select("best.row_key")
    wordless = F.coalesce(F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) == 0, F.lit(True))
    kept = keyed.where(~wordless).join(best, "row_key", "left_semi").dropDuplicates(["row_key"])
    return kept.select(*COLUMNS).union(docs.where(wordless).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, each row by its own text. Null and empty texts have no words and stay; repeated rows
    stay or go together; an empty table, or benchmark, changes nothing; further columns are left out."""
    return decontaminate.match_benchmark(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), whole=True).where("not contaminated").select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by [EMAIL], [IP], [CARD] and [PHONE]; n_chars follows the text. Null texts stay null, with
    null n_chars; repeated rows stay; an empty table gives no rows; further columns are left out."""
    return pii.mask_texts(docs, "text").select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids, checked by decoding: doc_id, source, lang, n_chars, n_pieces, ids_sha256, round_trip. Null texts
    count as empty: no pieces; repeated rows stay; an empty table gives no rows; further columns are left out."""
    encoded = lattice.encode_texts(docs.withColumn("text", F.coalesce("text", F.lit(""))), model_path(), decoded_col="decoded")
    return encoded.select(
        "doc_id", "lang", "source", "n_chars", F.size("piece_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("piece_ids", ","), 256).alias("ids_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_group),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("sentencepiece", encode),
]
#: The random field and the Viterbi fold cannot be stated in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again. What a stage stored on its way, and
    the result that it read, are deleted once its own is written."""
    docs = table(spark, sf_dir, "documents")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
