"""Dictionary curation: merging, removing what mustn't be in it, choosing spellings, breaking cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T

#: Where a swap of letters, two edits, would lead to a worse choice.
KEEP = [("alinging", "aligning"), ("alingment", "alignment"), ("alingments", "alignments")]


def merge(entries: DataFrame) -> DataFrame:
    """(pos, key, corrections) -> (key, corrections): keys in lower case, corrections in the order in
    which they first came, each once."""
    in_order = F.array_sort(F.collect_list(F.struct("pos", "corrections")))
    return entries.groupBy(F.lower("key").alias("key")).agg(F.array_distinct(F.flatten(in_order["corrections"])).alias("corrections"))


def invert(pairs: DataFrame) -> DataFrame:
    """(good, bads) -> (key, corrections), corrections sorted."""
    return pairs.select("good", F.explode("bads").alias("key")).groupBy("key").agg(F.sort_array(F.collect_set("good")).alias("corrections"))


def only_words(entries: DataFrame) -> DataFrame:
    """Drop keys and corrections that aren't letters throughout."""
    letters = F.lit(r"^\p{IsAlphabetic}+$")
    return entries.where(F.rlike("key", letters)).withColumn("corrections", F.filter("corrections", lambda c: F.rlike(c, letters)))


def is_one_word(text):
    """Whether a text has exactly one word and no underscore."""
    return (F.size(F.flatten(F.transform(T.identifiers(text), T.words))) == 1) & ~F.contains(text, F.lit("_"))


def single_words(entries: DataFrame) -> DataFrame:
    """Like :func:`only_words`, but what counts is that the tokenizer finds one word."""
    return entries.where(is_one_word(F.col("key"))).withColumn("corrections", F.filter("corrections", is_one_word))


def without(entries: DataFrame, words: DataFrame) -> DataFrame:
    """Drop keys that are among (word), whatever their case."""
    return entries.join(words.select(F.lower("word").alias("key")), "key", "left_anti")


def best_match(entries: DataFrame, variants: DataFrame) -> DataFrame:
    """Replace a correction by that spelling of it, of (word, variant), which is nearest to the key,
    if it is nearer than the correction itself; ties go by spelling."""
    each = entries.select("key", F.posexplode_outer("corrections").alias("i", "c"))
    kept = F.struct("key", "c").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in KEEP])
    distance = F.levenshtein("key", "variant")
    nearer = each.join(variants, F.col("c") == F.col("word")).where(~kept & (distance < F.levenshtein("key", "c")))
    nearest = nearer.groupBy("key", "i").agg(F.min(F.struct(distance.alias("d"), "variant"))["variant"].alias("best"))
    chosen = each.join(nearest, ["key", "i"], "left").select("key", "i", F.coalesce("best", "c").alias("c"))
    return chosen.groupBy("key").agg(F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("i", "c"))))["c"]).alias("corrections"))


def without_cycles(entries: DataFrame) -> DataFrame:
    """Drop keys that are a correction of another key."""
    goods = entries.select(F.explode("corrections").alias("good")).select(F.lower("good").alias("key")).distinct()
    return entries.join(goods, "key", "left_anti")


def process(entries: DataFrame, dialect_words: DataFrame | None = None, allowed: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
    """All steps, from (pos, key, corrections) to (key, corrections)."""
    out = only_words(merge(entries))
    for words in (dialect_words, allowed):
        if words is not None:
            out = without(out, words)
    if variants is not None:
        out = best_match(out, variants)
    return without_cycles(out)
