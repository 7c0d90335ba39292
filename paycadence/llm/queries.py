"""The queries of this package and, where SQL can say the same, their DuckDB checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, fingerprints, first_fit, manifest, mixing, neardup, packing, pii, quality, repeats, rules, sharding, toxicity
from .common import table
from .oracles import MERKLE, rotated_clusters


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_sampled_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed_bytes(table(spark, sf_dir, "documents"))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    names = {"__block": "block", "__slot": "slot", "__release": "release", "__deadline": "deadline", "__position": "position"}
    return mixed.withColumnsRenamed(names)


def op5_toxicity_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op9_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op10_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_covered_words longest_repeat"
    return rules.apply_rules(table(spark, sf_dir, "documents")).select(*columns.split())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op12_first_fit_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_fit.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op13_rotated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_additive,
        op2_personal_data,
        op3_sampled_suffix_repeats,
        op4_pfair_mix,
        op5_toxicity_bags,
        op6_sum_of_squares_packing,
        op7_minimax_shards,
        op8_multiset_fingerprints,
        op9_bag_minhash,
        op10_suffix_repetition,
        op11_merkle_manifest,
        op12_first_fit_tournament,
        op13_rotated_clusters,
    )
}
ORACLES: dict[str, str] = {"op11_merkle_manifest": MERKLE, "op13_rotated_clusters": rotated_clusters()}
