"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, linededup, mixing, quality, secrets, sharding, simhash, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))[1]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % topk.EVERY == 0))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_removed")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def line_store_reversible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two insertions into a store, the second of which asks its filters, and a deletion."""
    docs = _table(spark, sf_dir, "documents")
    return linededup.reversible(docs, F.pmod("doc_id", F.lit(2)) == 1, F.pmod("doc_id", F.lit(5)) == 0)


def secret_ledger_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of all documents with all rules of which the ledger has half the documents and all rules but one."""
    return secrets.rescan(_table(spark, sf_dir, "documents"), F.pmod("doc_id", F.lit(2)) == 0, secrets.SQL_RULES)


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_mixing, op3_langid, op4_secrets, op5_sharding, op6_quality, op7_topk, op8_linededup, op9_bpe, op10_licenses, line_store_reversible, secret_ledger_rescan)
}
ORACLES = {"op2_mixing": mixing.SQL, "op4_secrets": secrets.SQL, "op5_sharding": sharding.SQL, "op7_topk": topk.SQL, "op8_linededup": linededup.SQL, "line_store_reversible": linededup.REVERSIBLE_SQL, "secret_ledger_rescan": secrets.SQL}
