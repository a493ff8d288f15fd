"""English dialects: clusters of spelling variants, read, completed, compiled and applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Categories: A American, B British "ise", Z British "ize", C Canadian, D Australian, _ other.
VALID = {"A": 1, "B": 2, "C": 4, "D": 8}
ALL = 15
LOCALES = {"en": None, "en-us": "A", "en-gb": "B", "en-ca": "C", "en-au": "D"}
POS = ("N", "V", "Adj", "Adv", "A", "Inj", "Prep")
_TYPE = r"([ABZCD_])([.vV\-x]?)([0-9]*)"


def parse(files: DataFrame) -> DataFrame:
    """(value): whole files of clusters, parted by blank lines, as rows (cluster, header, verified,
    level, entry, variant, word, category, tag, num, pos, archaic, note, description, comment).

    A cluster begins ``# head <verified> (level N)``; each entry is variants joined by ``/``, each
    ``types: word``, then optionally ``| pos ...`` and ``# comment``; ``##`` lines are notes.
    """
    blocks = files.select(F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), r"\n[ \t]*\n")).alias("cluster", "block")).where(F.trim("block") != "")
    lines = F.filter(F.split(F.trim(F.col("block")), "\n"), lambda x: F.trim(x) != "")
    head = F.element_at(F.filter(lines, lambda x: F.rlike(x, F.lit("^# "))), 1)
    body = F.filter(lines, lambda x: ~F.startswith(x, F.lit("#")))
    entries = blocks.select(
        "cluster",
        F.regexp_extract(head, r"^#\s+(\S+)", 1).alias("header"),
        F.contains(head, F.lit("<verified>")).alias("verified"),
        F.expr("try_cast(regexp_extract(filter(split(trim(block), '\\n'), x -> x rlike '^# ')[0], 'level ([0-9]+)', 1) as int)").alias("level"),
        F.posexplode(body).alias("entry", "line"),
    )
    line = F.trim(F.regexp_replace("line", r"\s*#.*$", ""))
    left, right = F.trim(F.split(line, r"\|", 2)[0]), F.trim(F.get(F.split(line, r"\|", 2), F.lit(1)))
    note = F.get(F.split(right, "--", 2), F.lit(1))
    variants = entries.select(
        "cluster", "header", "verified", "level", "entry",
        F.nullif(F.regexp_extract(right, r"(?:^|\s)<?(" + "|".join(sorted(POS, key=len, reverse=True)) + r")>?(?:\s|$)", 1), F.lit("")).alias("pos"),
        F.coalesce(F.contains(right, F.lit("(-)")), F.lit(False)).alias("archaic"),
        F.coalesce(F.rlike(right, F.lit("(^| )--( |$)")), F.lit(False)).alias("note"),
        F.nullif(F.trim(F.coalesce(note, F.regexp_replace(right, r"^(?:<?(?:abbr|pl)>?\s+)*(?:<?(?:" + "|".join(POS) + r")>?)?\s*(?:\(-\))?", ""))), F.lit("")).alias("description"),
        F.nullif(F.trim(F.regexp_extract("line", r"#(.*)$", 1)), F.lit("")).alias("comment"),
        F.posexplode(F.split(left, r"\s*/\s*")).alias("variant", "v"),
    )
    word = F.replace(F.trim(F.get(F.split("v", ":", 2), F.lit(1))), F.lit("_"), F.lit(" "))
    types = F.filter(F.split(F.trim(F.split("v", ":", 2)[0]), r"\s+"), lambda x: x != "")
    rows = variants.select(*[c for c in variants.columns if c != "v"], word.alias("word"), F.explode(types).alias("t"))
    part = lambda i: F.nullif(F.regexp_extract("t", f"^{_TYPE}", i), F.lit(""))
    return rows.select(*[c for c in rows.columns if c != "t"], part(1).alias("category"), part(2).alias("tag"), part(3).cast("int").alias("num"))


def infer(rows: DataFrame) -> DataFrame:
    """Complete entries: without Z, B counts as Z; then without C, Z counts as C; without D, B as D."""
    here = W.partitionBy("cluster", "entry")
    has = lambda c: F.coalesce(F.bool_or(F.col("category") == c).over(here), F.lit(False))
    flagged = rows.withColumns({"__z": has("Z"), "__c": has("C"), "__d": has("D")})
    british, ize = F.col("category") == "B", F.col("category") == "Z"
    more = F.array(
        F.col("category"),
        F.when(british & ~F.col("__z"), F.lit("Z")),
        F.when(~F.col("__c") & (ize | (british & ~F.col("__z"))), F.lit("C")),
        F.when(british & ~F.col("__d"), F.lit("D")),
    )
    each = flagged.withColumn("__more", F.explode(F.array_compact(more)))
    return each.select(*[F.col("__more").alias(c) if c == "category" else F.col(c) for c in rows.columns])


def _bit(category: Column) -> Column:
    mask = F.lit(0)
    for name, bit in VALID.items():
        mask = F.when(category == name, bit).otherwise(mask)
    return F.when(category == "_", ALL).otherwise(mask)


def compile(rows: DataFrame) -> DataFrame:
    """(word, mask, A, B, C, D): for words that some dialect doesn't have, the dialects that do,
    as bits, and the spellings of each dialect. Entries count if their cluster is verified and all
    their variants are single words. Of a word in several entries the first entry stands."""
    entry = ["cluster", "entry"]
    whole = rows.where("verified").groupBy(*entry).agg(F.bool_and(F.rlike("word", F.lit(r"^(?:\p{IsUppercase}?\p{IsLowercase}+|\p{IsUppercase}+)$"))).alias("__whole"))
    rows = rows.where("verified").join(whole.where("__whole").drop("__whole"), entry).withColumn("word", F.translate("word", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    masks = rows.groupBy(*entry, "word").agg(F.bit_or(_bit(F.col("category"))).alias("mask"))
    count = rows.groupBy(*entry, "word", "variant").agg(F.count("*").alias("__types"), F.max("category").alias("__c"), F.max("tag").alias("__t"))
    skip = (F.col("word") == "anesthetisation") & (F.col("__types") == 1) & (F.col("__c") == "D") & F.col("__t").isin("v", "V")
    rows = rows.join(count.where(skip).select(*entry, "word", "variant"), [*entry, "word", "variant"], "left_anti")
    sides = []
    for c in VALID:
        here = F.col("category").isin(c, "_")
        primary = F.collect_set(F.when(here & F.coalesce("tag", F.lit(".")).isin("."), F.col("word")))
        backup = F.collect_set(F.when(here & (F.coalesce("tag", F.lit(".")) != "x"), F.col("word")))
        sides.append(F.sort_array(F.when(F.size(primary) == 1, primary).otherwise(backup)).alias(c))
    spellings = rows.groupBy(*entry).agg(*sides)
    links = masks.join(spellings, entry)
    always = F.bool_or(F.col("mask") == ALL).alias("__always")
    first = F.min_by(F.struct("mask", *VALID), F.struct(*entry)).alias("__first")
    return links.groupBy("word").agg(always, first).where("not __always").select("word", "__first.*")


def variants(rows: DataFrame) -> DataFrame:
    """(word, variant): the other spellings of a word's verified entries, improper ones left out."""
    entry = ["cluster", "entry"]
    proper = rows.where("verified and coalesce(tag, '.') <> 'x'").select(*entry, "word").distinct()
    other = proper.withColumnRenamed("word", "variant")
    return proper.join(other, entry).where("word <> variant").select("word", "variant").distinct()


def status(mask: Column, spellings: Column, bit: int) -> Column:
    """Valid, or the corrections for a dialect, of a compiled word; null if there is none."""
    return F.when(mask.isNull(), None).when(mask.bitwiseAND(F.lit(bit)) != 0, F.struct(F.lit("Valid").alias("status"), F.expr("cast(array() as array<string>)").alias("corrections"))).otherwise(
        F.struct(F.lit("Corrections").alias("status"), spellings.alias("corrections"))
    )


def chain(dictionary: DataFrame, compiled: DataFrame | None, locale: str = "en") -> DataFrame:
    """(key, status, corrections): a dictionary (key, corrections) seen from a dialect. Corrections
    that the dialect spells otherwise are replaced, and unless one is left, sorted without repeats. Words
    that aren't in the dictionary get the dialect's verdict. ``en`` knows no dialects."""
    letter = LOCALES[locale]
    keyed = dictionary.select(F.lower("key").alias("key"), "corrections")
    plain = F.when(F.size("corrections") == 0, "Invalid").otherwise("Corrections").alias("status")
    if letter is None or compiled is None:
        return keyed.select("key", plain, "corrections")
    seen = compiled.select(F.col("word").alias("__w"), F.col("mask").alias("__m"), F.col(letter).alias("__s"))
    bit = VALID[letter]
    one = keyed.select("key", F.posexplode_outer("corrections").alias("__i", "__c")).join(seen, F.lower("__c") == F.col("__w"), "left")
    fixed = F.when(F.col("__m").isNull() | (F.col("__m").bitwiseAND(F.lit(bit)) != 0), F.array("__c")).otherwise(F.col("__s"))
    merged = one.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("__c").isNotNull(), F.struct("__i", fixed.alias("f"))))).alias("__l"))
    flat = F.flatten(F.col("__l.f"))
    chained = merged.select("key", F.when(F.size(flat) == 1, flat).otherwise(F.array_sort(F.array_distinct(flat))).alias("corrections"))
    chained = chained.select("key", plain, "corrections")
    alone = seen.join(chained.select("key"), F.col("__w") == F.col("key"), "left_anti")
    verdict = status(F.col("__m"), F.col("__s"), bit)
    return chained.unionByName(alone.select(F.col("__w").alias("key"), verdict["status"].alias("status"), verdict["corrections"].alias("corrections")))
