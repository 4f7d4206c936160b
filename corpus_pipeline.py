"""The corpus pipeline: STAGES applied in order to the documents table, each stage's rows written and read again.

Every stage takes empty tables (no rows come out), nulls in any column, empty and very long texts, repeated rows and ids
(each row is judged by its own id and text) and further columns of any name, which it leaves behind: all but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.debruijn import repeated_passages
from rangeloom.llm.minhash import near_duplicates
from rangeloom.llm.mixing import mix_sources
from rangeloom.llm.packing import pack
from rangeloom.llm.quality import quality_rules
from rangeloom.llm.queries import tokenizer_path
from rangeloom.llm.store import cut, ensure_checkpoint_dir
from rangeloom.operators.neighbours import ordinal

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``row_key``: equal only for rows of the same id, or of none, and the same text."""
    text = F.concat(F.when(F.col("text").isNull(), "n").otherwise("t"), F.coalesce("text", F.lit("")))
    return docs.withColumn("row_key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, each row by its own verdict, whatever its id; null and empty texts have too few words. Equal rows share their verdict."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = keyed(docs)
    kept = quality_rules(docs, labels, carry=("row_key",)).filter("kept").select("row_key").distinct()
    return docs.join(kept, "row_key", "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id. Texts that share an id are documents of their own; rows of null id, null or empty text stay; rows that repeat id and text stay or go together."""
    docs = keyed(docs)
    texts = cut(docs.filter("doc_id is not null").select("doc_id", "row_key").distinct())
    if texts.groupBy("doc_id").count().filter("count > 1").isEmpty():
        docs = docs.withColumn("row_id", F.col("doc_id"))
    else:
        places = cut(ordinal(texts, "doc_id", "row_id")).select("row_key", "row_id")
        docs = docs.join(places, "row_key", "left")
    gone = near_duplicates(docs, id_col="row_id", shingle=5, percent=80).filter("not kept").select("row_id").distinct()
    return docs.join(gone, "row_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 13-word passages go from all documents but the first; a document of which no word is left goes too. Rows of null id count as the last; null, empty and short texts stay as they are. ``n_chars`` is counted anew where words went."""
    rows = repeated_passages(docs.withColumn("no_text", F.col("text").isNull()), k=13, full=True, carry=("lang", "source", "n_chars", "no_text"))
    touched = F.col("n_removed") > 0
    rows = rows.filter(~touched | (F.col("n_words") > F.col("n_removed")))
    return rows.select("doc_id", F.when(~F.col("no_text"), F.col("text")).alias("text"), "lang", "source", F.when(touched, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to their target weights and shuffled globally; a null source is a source of its own name '', rows that repeat an id draw the same count, those of null id draw by their text."""
    return mix_sources(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, in the shuffled order: at least one per row, null and empty texts are their end mark alone."""
    return pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: The likelihood ratio, the component search and the tokenizer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what passes between stages is Parquet in the checkpoint folder, of which the last stage's input alone is left there for the caller's reads."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:  # the stage before it is not read again
            _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
