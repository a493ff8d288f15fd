"""Finding misspellings: identifiers, then words, against a lexicon; ignored places left out.

A check is one narrow pass over the rows: a task reads its texts with :mod:`functions.scan` and gives a
row for each finding, so nothing is shuffled and texts go no further. The lexicon, whose size doesn't
depend on the corpus, is measured first and broadcast, in several parts with a pass for each if it is
larger than ``BROADCAST_BYTES``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ..functions import scan
from ..shipping import map_arrow
from . import dialect

#: Identifiers that look like misspellings and aren't.
BUILT_IN = ("O_WRONLY", "dBA")
#: Bytes of a lexicon that are broadcast at once.
BROADCAST_BYTES = 64 << 20
#: What an entry takes in a task besides its letters.
ENTRY_BYTES = 300
#: Bytes of lines that leave a task at once: every finding has its line, however long, so they can be far
#: more than the text.
LINE_BYTES = 1 << 20
FOUND = StructType([
    StructField("kind", StringType(), False), StructField("byte_offset", LongType(), False), StructField("line_num", LongType()), StructField("line_byte_offset", LongType(), False),
    StructField("typo", StringType(), False), StructField("status", StringType(), False), StructField("corrections", ArrayType(StringType()), False),
])
#: What is given besides if asked for: the line that holds the finding, and the code points before it there.
PLACED = StructType([StructField("line", StringType(), False), StructField("prefix_chars", LongType(), False)])


@dataclass
class Lexicon:
    """words: (key, status, corrections) by key in lower case, as rows or as a mapping; identifiers: by
    exact spelling; expressions that make identifiers and words valid."""

    words: DataFrame | Mapping[str, scan.Verdict]
    identifiers: Mapping[str, scan.Verdict] = field(default_factory=dict)
    ignore_identifiers: Sequence[str] = field(default_factory=tuple)
    ignore_words: Sequence[str] = field(default_factory=tuple)
    held: list | None = None

    def parts(self, spark: SparkSession) -> list:
        """Broadcast matchers, each of a part of the words that is within the bound."""
        if self.held is None:
            self.held = [spark.sparkContext.broadcast(m) for m in self._matchers()]
        return self.held

    def _matchers(self):
        if isinstance(self.words, Mapping):
            total = sum(ENTRY_BYTES + len(k) for k in self.words)
            n = max(1, -(-total // BROADCAST_BYTES))
            items = list(self.words.items())
            pieces = (dict(items[i::n]) for i in range(n))
        else:
            size = F.octet_length("key") + F.aggregate(F.coalesce("corrections", F.array().cast("array<string>")), F.lit(0), lambda a, c: a + F.coalesce(F.octet_length(c), F.lit(0)))
            total = self.words.agg(F.sum((size + ENTRY_BYTES).cast("bigint"))).first()[0] or 0
            n = max(1, -(-total // BROADCAST_BYTES))
            pieces = (self._piece(i, n) for i in range(n))
        for i, words in enumerate(pieces):
            yield scan.Matcher(words, self.identifiers, tuple(map(translate_pattern, self.ignore_identifiers)), tuple(map(translate_pattern, self.ignore_words)), own_names=i == 0)

    def _piece(self, i: int, n: int) -> dict[str, scan.Verdict]:
        rows = self.words.where(F.col("key").isNotNull() & (F.col("status") != "Valid") & (F.pmod(F.xxhash64("key"), F.lit(n)) == i))
        return {r.key.lower(): (r.status, tuple(r.corrections or ())) for r in rows.select("key", "status", "corrections").collect()}


def interpret(overrides: Mapping[str, str]) -> list[tuple]:
    """A word mapped to itself is valid, to nothing disallowed, else corrected."""
    return [(k, "Valid", []) if k == v else (k, "Invalid", []) if v == "" else (k, "Corrections", [v]) for k, v in overrides.items()]


def lexicon(spark: SparkSession, dictionary: DataFrame | Mapping[str, Sequence[str]] | None = None, compiled: DataFrame | None = None, locale: str = "en", words: Mapping[str, str] | None = None, identifiers: Mapping[str, str] | None = None, ignore_identifiers: Sequence[str] = (), ignore_words: Sequence[str] = ()) -> Lexicon:
    """Overrides come before the dictionary, the dictionary before the dialect. Of words that differ
    in case alone the last one counts."""
    over = {k.lower(): (s, tuple(c)) for k, s, c in interpret(words or {})}
    named = {i: ("Valid", ()) for i in BUILT_IN} | {k: (s, tuple(c)) for k, s, c in interpret(identifiers or {})}
    if dialect.LOCALES[locale] is None or compiled is None:
        if dictionary is None or isinstance(dictionary, Mapping):
            base = {k.lower(): ("Corrections" if c else "Invalid", tuple(c)) for k, c in (dictionary or {}).items()}
            return Lexicon(base | over, named, tuple(ignore_identifiers), tuple(ignore_words))
    if dictionary is None or isinstance(dictionary, Mapping):
        dictionary = spark.createDataFrame([(k, list(c)) for k, c in (dictionary or {}).items()], "key string, corrections array<string>")
    known = dialect.chain(dictionary, compiled, locale)
    if over:
        rows = spark.createDataFrame([(k, s, list(c)) for k, (s, c) in over.items()], "key string, status string, corrections array<string>")
        known = known.join(F.broadcast(rows.select("key")), "key", "left_anti").unionByName(rows)  # a project's own words
    return Lexicon(known, named, tuple(ignore_identifiers), tuple(ignore_words))


def translate_pattern(pattern: str) -> str:
    """An expression whose line ends may be CR LF (flag R), as one that Python and Java know."""
    found = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if not found or "R" not in found[1]:
        return pattern
    rest = found[1].replace("R", "")
    body = re.sub(r"\\.|\[(?:\\.|[^\]])*\]|\$", lambda m: r"(?=\r?$)" if m[0] == "$" else m[0], pattern[found.end() :])
    return (f"(?{rest})" if rest else "") + body


def _apart(found, at: np.ndarray, row: np.ndarray, data: np.ndarray, offsets: np.ndarray, patterns) -> np.ndarray:
    """Which findings have neither their first nor their last byte in a place that is ignored; a place
    that lies inside one doesn't count."""
    keep = np.ones(len(found), bool)
    for r in np.unique(row):
        places = scan.blocks(bytes(data[offsets[r] : offsets[r + 1]]), patterns)
        if places:
            own = np.flatnonzero(row == r)
            first = at[own] - offsets[r]
            last = first + np.array([len(found[i][2].encode()) for i in own]) - 1
            for x, y in places:
                keep[own[((x <= first) & (first < y)) | ((x <= last) & (last < y))]] = False
    return keep


def _found(matcher: scan.Matcher, column: pa.Array, ignore, unicode: bool, valid: bool):
    """(first row, bytes, offsets, row, place, findings) of each slab of a column."""
    for first, _, data, offsets in scan.slabs(column):
        at, found = matcher.find(data, offsets, unicode, valid)
        row = np.searchsorted(offsets, at, "right") - 1
        if ignore and len(found):
            keep = np.flatnonzero(_apart(found, at, row, data, offsets, ignore))
            at, row, found = at[keep], row[keep], [found[i] for i in keep]
        yield first, data, offsets, row, at, found


def _line_ends(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where the lines that begin at places in rows end."""
    feeds = np.r_[np.flatnonzero(data == 10), len(data)]
    return np.minimum(feeds[np.searchsorted(feeds, begin)], offsets[1:][row])


def _runs(size: np.ndarray | None, n: int) -> Iterator[slice]:
    """Runs of ``n`` findings whose lines have about ``LINE_BYTES``; a longer line is alone."""
    if size is None:
        yield slice(0, n)
        return
    total, i = np.r_[0, np.cumsum(size)], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + LINE_BYTES, "right")) - 1)
        yield slice(i, j)
        i = j


def _before(data: np.ndarray, begin: np.ndarray, at: np.ndarray, valid: bool) -> np.ndarray:
    """How many code points stand from ``begin`` to ``at``."""
    if valid:
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        return points[at] - points[begin]
    return np.array([len(bytes(data[x:y]).decode("utf-8", "replace")) for x, y in zip(begin.tolist(), at.tolist(), strict=True)], np.int64)


def _backticked(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def findings(rows: DataFrame, lex: Lexicon, text: str = "text", keep: Sequence[str] = (), ignore: Sequence[str] = (), unicode: bool = True, placed: bool | Sequence[str] = False) -> DataFrame:
    """The columns ``keep`` with kind (identifier or word), byte_offset, line_num, line_byte_offset,
    typo, status (Invalid or Corrections) and corrections, one row for each misspelling; ``placed``: with
    line and prefix_chars too, or with those of them that it names. ``text`` is a string column, or a binary one, in which every valid piece
    of UTF-8 is read by itself. Without ``unicode`` identifiers are read by bytes.

    Null texts have none. Rows are independent; repeated rows repeat their findings.
    """
    patterns = [re.compile(translate_pattern(p)) for p in ignore]
    base = rows.select(*[_backticked(c) for c in keep], F.col(text).alias("__text"))
    valid = not isinstance(base.schema["__text"].dataType, BinaryType)
    n = len(keep)
    besides = [f for f in PLACED.fields if placed is True or placed and f.name in placed]
    schema = StructType([*base.schema.fields[:n], *FOUND.fields, *besides])
    lines, points = (any(f.name == x for f in besides) for x in ("line", "prefix_chars"))

    def one(shared):
        def run(batches):
            matcher = shared.value.ready()
            for b in batches:
                for first, data, offsets, row, at, found in _found(matcher, b.column(n), patterns, unicode, valid):
                    if not len(found):
                        continue
                    number, begin = scan.lines(data, offsets, row, at)
                    end = _line_ends(data, offsets, row, begin) if lines else None
                    before = _before(data, begin, at, valid) if points else None
                    for own in _runs(end - begin if lines else None, len(found)):
                        columns = [c.take(pa.array(row[own] + first)) for c in b.columns[:n]]
                        kind, _, typo, status, corrections = zip(*found[own], strict=True)
                        columns += [
                            pa.array(kind, pa.string()), pa.array((at - offsets[row])[own]), pa.array(number[own]), pa.array((at - begin)[own]),
                            pa.array(typo, pa.string()), pa.array(status, pa.string()), pa.array(map(list, corrections), pa.list_(pa.string())),
                        ]
                        if lines:
                            columns.append(pa.array([bytes(data[x:y]).decode("utf-8", "replace").removesuffix("\r") for x, y in zip(begin[own].tolist(), end[own].tolist(), strict=True)], pa.string()))
                        if points:
                            columns.append(pa.array(before[own]))
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return run

    return reduce(DataFrame.unionAll, [map_arrow(base, one(part), schema) for part in lex.parts(rows.sparkSession)])


def check_files(files: DataFrame, lex: Lexicon, path: str = "path", text: str = "text", ignore: Sequence[str] = (), names: bool = True, contents: bool = True, unicode: bool = True, placed: bool | Sequence[str] = False) -> DataFrame:
    """Findings in file names (line_num null; only the last part of a path) and in contents."""
    parts = []
    if names:
        named = files.select(path, F.element_at(F.split(path, "/"), -1).alias("__name"))
        parts.append(findings(named, lex, "__name", [path], ignore, unicode, placed).withColumn("line_num", F.lit(None).cast("bigint")))
    if contents:
        parts.append(findings(files, lex, text, [path], ignore, unicode, placed))
    if not parts:
        return findings(files.limit(0), lex, text, [path], placed=placed)
    return reduce(DataFrame.unionByName, parts)


def is_fixable(corrections: Column) -> Column:
    return F.size(corrections) == 1


def status_flags(found: DataFrame) -> DataFrame:
    """(any_typo, any_error, exit_code): 0 clean, 2 with findings, 1 with errors."""
    error = F.col("status") == "Error" if "status" in found.columns else F.lit(False)
    flags = found.agg(F.coalesce(F.bool_or(~error), F.lit(False)).alias("any_typo"), F.coalesce(F.bool_or(error), F.lit(False)).alias("any_error"))
    return flags.withColumn("exit_code", F.when(F.col("any_error"), 1).when(F.col("any_typo"), 2).otherwise(0))
