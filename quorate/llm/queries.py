"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quorate.llm.ann import nearest
from quorate.llm.common import table
from quorate.llm.jaccard import jaccard_components
from quorate.llm.lexical import RANKED_SEARCH_SQL, ranked_search
from quorate.llm.licenses import LICENSE_SQL, scan_licenses
from quorate.llm.linededup import LINE_DEDUP_SQL, line_dedup_digests
from quorate.llm.lm import lm_scores
from quorate.llm.mixing import MIX_SQL, mix
from quorate.llm.neardup import near_duplicates
from quorate.llm.packing import pack
from quorate.llm.prefixtrie import PREFIX_TRIE_SQL, prefix_nodes
from quorate.llm.sharding import shard_by_bytes
from quorate.llm.toxicity import toxicity_scores
from quorate.llm.warc import archive_digests


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digests(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_embedding_near_dedup, op3_source_mixing, op4_toxicity, op5_warc, op6_packing, op7_lm_scoring, op8_license_scan, op9_nearest_neighbours, op10_sharding, op11_ranked_search, op12_line_dedup, op13_prefix_trie)}

ORACLE = {"op8_license_scan": LICENSE_SQL, "op3_source_mixing": MIX_SQL, "op11_ranked_search": RANKED_SEARCH_SQL, "op12_line_dedup": LINE_DEDUP_SQL, "op13_prefix_trie": PREFIX_TRIE_SQL}
