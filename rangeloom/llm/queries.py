"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import debruijn, linkgraph, minhash, mixing, multiindex
from .debruijn import repeated_passages
from .html_tree import extract_main_text
from .minhash import near_duplicates
from .multiindex import near_vectors
from .packing import pack
from .quality import quality_rules
from .toxicity import classify
from .warc import build_derivatives

#: The chain of the toxicity query: text that labellers call poor comes first, its probability feeds the toxic model.
TOXIC_CHAIN = {"poor": "quality = 0", "toxic": "toxic = 1"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), TOXIC_CHAIN)
    return found.select("doc_id", "p_poor", "p_toxic", found["is_toxic"].alias("toxic"))


def op2_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op3_dynamic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.drop("score", "threshold")


def op5_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge_urls(_table(spark, sf_dir, "pages"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_derivatives(_table(spark, sf_dir, "pages"))


def op10_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"), k=13)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity_chain, op2_html_tree_model, op3_dynamic_packing, op4_quality_ratio, op5_host_trust, op6_poisson_mixing, op7_multi_index, op8_setsketch_near_dedup, op9_warc_derivatives, op10_debruijn_substrings)
}
ORACLES: dict[str, str] = {"op5_host_trust": linkgraph.ORACLE, "op6_poisson_mixing": mixing.ORACLE, "op7_multi_index": multiindex.ORACLE, "op8_setsketch_near_dedup": minhash.ORACLE, "op10_debruijn_substrings": debruijn.ORACLE}
