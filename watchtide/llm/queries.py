"""The operators of this subpackage as registered queries, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, licences, merkle, neighbours, oracles, piece_sampling, quality, ranked_search, sharding, simhash, suffixes, token_files, toxicity, word_bpe
from .common import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


@query("op2_sharding", oracles.SHARDING)
def _sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=24)


@query("op3_simhash")
def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, size=4)


@query("op10_token_files")
def _token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder)
    return token_files.index(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op6_suffix_repeats", oracles.REPEATS)
def _suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), window=200, digest=True)


@query("op8_quality")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_toxicity")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_decontamination")
def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_piece_sampling")
def _piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_checked(table(spark, sf_dir, "documents"))


@query("op7_neighbours")
def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op1_licences")
def _licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op11_manifest", oracles.MANIFEST)
def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


@query("op12_word_bpe")
def _word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op13_ranked_search", oracles.RANKED)
def _ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)
