"""Findings of text that keeps arriving. Every check is stateless, so the batch operators serve."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import check


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stream of the Parquet files in a folder; a single file is its folder's file of that name."""
    schema = schema or spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        return source.option("pathGlobFilter", os.path.basename(local)).parquet(os.path.dirname(local))
    return source.parquet(path)


def findings(rows: DataFrame, lex: check.Lexicon, text: str = "text", keep=()) -> DataFrame:
    return check.findings(rows, lex, text, keep)


def counts(spark: SparkSession, path: str, lex: check.Lexicon) -> DataFrame:
    """(typo, n): runs what is there through a stream and gives the counts that come of it."""
    name = f"glyphwright_{uuid.uuid4().hex}"
    found = findings(read(spark, path), lex).groupBy(F.lower("typo").alias("typo")).agg(F.count("*").alias("n"))
    started = found.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.table(name)
