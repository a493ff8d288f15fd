"""Mixing sources to target weights, as weighted fair queueing.

Every source's documents are shuffled by a seeded hash. A document's virtual finish time is the
number of its source's tokens up to and including it, divided by the source's weight. All documents
are range-sorted by finish time and taken until the next one would exceed the budget of tokens.
A token is a run of characters other than space, tab and line breaks.

Only ids, sources and counts are sorted; texts aren't moved. Running sums need two narrow passes over
range partitions (:func:`_scale.running_sums`), so a hot source is spread over as many partitions as
its size asks for.

Defined cases: null texts count no tokens; a null source is a source of its own; sources without a
weight have the default one; weights must be positive. Ties of finish time go by hash, doc_id (null
first), source, and count; rows that are the same in all of these are interchangeable. A source that
runs out leaves its share to the others. Very long texts are counted whole, where they are; a document
longer than what is left of the budget ends the mixture. An empty table gives no rows. Other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scale

WEIGHTS = {"src0": 0.5, "src1": 2.0}
DEFAULT_WEIGHT = 1.0
BUDGET_PERCENT = 90
SEED = 20240229


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("bigint")


def _facts(docs: DataFrame, seed: int) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", key.alias("k"), token_count(F.col("text")).alias("n_tokens"))


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT, budget: int | None = None, budget_percent: int = BUDGET_PERCENT, seed: int = SEED) -> DataFrame:
    """The chosen documents: (doc_id, source, n_tokens, finish, total), total being the tokens
    chosen up to and including this one. ``budget``: tokens; if not given, ``budget_percent`` of
    all. Ordered by finish time within and across partitions."""
    return _mixed(docs, weights, default, budget, budget_percent, seed).drop("k")


def _mixed(docs, weights, default, budget, budget_percent, seed) -> DataFrame:
    if min([default, *weights.values()]) <= 0:
        raise ValueError("weights must be positive")
    ordered = _scale.range_sorted(_facts(docs, seed), "source", "k", "doc_id", "n_tokens")
    if budget is None:
        budget = (ordered.agg(F.sum("n_tokens")).first()[0] or 0) * budget_percent // 100
    weight = F.lit(float(default))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    timed = _scale.running_sums(ordered, "n_tokens", "cum", "source")
    timed = timed.select("doc_id", "source", "k", "n_tokens", (F.col("cum").cast("double") / weight).alias("finish"))
    queue = _scale.range_sorted(timed, "finish", "k", "doc_id", "source", "n_tokens")
    return _scale.running_sums(queue, "n_tokens", "total").where(F.col("total") <= F.lit(budget).cast("bigint"))


def keep_mixed(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT, budget: int | None = None, budget_percent: int = BUDGET_PERCENT, seed: int = SEED) -> DataFrame:
    """``docs`` reduced to what :func:`mix` chooses; columns as they were.

    What is chosen of a source is the beginning of its shuffled order, so one cut for each source
    says it all and no text is shuffled. Rows that equal the last one in id and count stay with it.
    """
    last = F.struct(F.col("k"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("n_tokens").alias("n"))
    cuts = _mixed(docs, weights, default, budget, budget_percent, seed).groupBy(F.col("source").alias("__gw_source")).agg(F.max(last).alias("__gw_cut"))
    cuts = _scale.stored(cuts, "cuts")
    if _scale.small_enough(cuts.count(), 200):
        cuts = F.broadcast(cuts)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))))
    doc = F.coalesce(docs["doc_id"].cast("bigint"), F.lit(-(1 << 63)))
    mine = F.struct(key.alias("k"), doc.alias("d"), token_count(docs["text"]).alias("n"))
    return docs.join(cuts, docs["source"].eqNullSafe(F.col("__gw_source")) & (mine <= F.col("__gw_cut")), "left_semi")


SQL = rf"""
WITH t AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS BIGINT) AS n
  FROM documents),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING) AS cum FROM t),
f AS (
  SELECT *, CAST(cum AS DOUBLE) / CASE source {' '.join(f"WHEN '{s}' THEN CAST({w} AS DOUBLE)" for s, w in WEIGHTS.items())} ELSE CAST({DEFAULT_WEIGHT} AS DOUBLE) END AS finish FROM c),
g AS (
  SELECT *, sum(n) OVER (ORDER BY finish, k, doc_id NULLS FIRST, source NULLS FIRST, n ROWS UNBOUNDED PRECEDING) AS total FROM f)
SELECT doc_id, source, n AS n_tokens, finish, CAST(total AS BIGINT) AS total
FROM g WHERE total <= (SELECT CAST(sum(n) AS BIGINT) * {BUDGET_PERCENT} // 100 FROM t)
"""
