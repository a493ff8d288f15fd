"""Readers of correction lists and allow lists: (key, corrections) or (word, reason)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _clean(parts):
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def ragged(lines: DataFrame) -> DataFrame:
    """``typo,correction[,correction...]`` lines, without a header; a line of one field disallows it."""
    parts = F.split("value", ",")
    return lines.where(F.trim("value") != "").select(F.trim(parts[0]).alias("key"), _clean(F.slice(parts, 2, 1 << 30)).alias("corrections"))


def arrows(lines: DataFrame) -> DataFrame:
    """``typo->a, b,`` lines."""
    parts = F.split("value", "->", 2)
    return lines.where(F.contains("value", F.lit("->"))).select(F.trim(parts[0]).alias("key"), _clean(F.split(parts[1], ",")).alias("corrections"))


def inverted(documents: DataFrame) -> DataFrame:
    """JSON objects ``{good: [bad, ...]}``, as (key, corrections) with corrections in order."""
    pairs = documents.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("good", "bads"))
    return pairs.select("good", F.explode("bads").alias("key")).groupBy("key").agg(F.sort_array(F.collect_set("good")).alias("corrections"))


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    return ragged(spark.read.text(path))


def read_arrows(spark: SparkSession, path: str) -> DataFrame:
    return arrows(spark.read.text(path))


def read_inverted(spark: SparkSession, path: str) -> DataFrame:
    return inverted(spark.read.text(path, wholetext=True))


def read_allowed(spark: SparkSession, path: str) -> DataFrame:
    """``word[,reason]`` lines as (word, reason), words in lower case."""
    parts = F.split("value", ",", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(F.lower(F.trim(parts[0])).alias("word"), F.trim(F.get(parts, F.lit(1))).alias("reason"))


def allow_list(*lists: DataFrame) -> DataFrame:
    """The union of (word, reason) lists; of a word in several the last list's reason stands."""
    ranked = None
    for i, x in enumerate(lists):
        x = x.select("word", "reason", F.lit(i).alias("source"))
        ranked = x if ranked is None else ranked.unionByName(x)
    return ranked.groupBy("word").agg(F.max_by("reason", "source").alias("reason"))
