"""Corrected text and diffs."""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..shipping import map_arrow, ship
from . import check


def splice(text: Column, fixes: Column) -> Column:
    """``text`` with each of ``fixes`` (array of byte_offset, typo, fix; in any order, apart from
    each other) put in its place."""
    raw = text.cast("binary")
    nothing = F.lit("").cast("binary")

    def step(acc, f):
        kept = F.substr(raw, (acc["at"] + 1).cast("int"), (f["byte_offset"] - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["out"], kept, f["fix"].cast("binary")).alias("out"), (f["byte_offset"] + F.octet_length(f["typo"])).cast("bigint").alias("at"))

    start = F.struct(nothing.alias("out"), F.lit(0).cast("bigint").alias("at"))
    return F.aggregate(F.array_sort(fixes), start, step, lambda a: F.concat(a["out"], F.substr(raw, (a["at"] + 1).cast("int"))).cast("string"))


_FIXES = ArrayType(StructType([StructField("at", LongType()), StructField("size", LongType()), StructField("fix", StringType())]))


def put(text: bytes, fixes: Sequence[tuple[int, int, str]]) -> bytes:
    """``text`` with each of ``fixes`` (place, size of what is there, what comes there; apart from each
    other) put in."""
    out, at = [], 0
    for start, size, fix in sorted(fixes):
        out += [text[at:start], fix.encode()]
        at = start + size
    return b"".join([*out, text[at:]])


def fix_text(rows: DataFrame, lex: check.Lexicon, text: str = "text", ignore: Sequence[str] = (), unicode: bool = True) -> DataFrame:
    """``rows`` with fixed_text and n_fixed: what has exactly one correction is corrected. Every row is
    corrected by itself, where it is; columns of these names are replaced. A binary ``text`` gives a
    binary fixed_text."""
    patterns = [re.compile(check.translate_pattern(p)) for p in ignore]
    kept = [c for c in rows.columns if c.lower() not in ("fixed_text", "n_fixed")]
    rows = rows.select(*[F.col(check._backticked(c)) for c in kept])
    fields, at = rows.schema.fields, [c.lower() for c in kept].index(text.lower())
    binary = isinstance(fields[at].dataType, BinaryType)
    parts = lex.parts(rows.sparkSession)
    ends = [StructField("fixed_text", fields[at].dataType), StructField("n_fixed", IntegerType(), False)]

    def one(shared, first, last):
        def run(batches):
            matcher = shared.value.ready()
            for b in batches:
                if not b.num_rows:
                    continue
                held = [[] for _ in range(b.num_rows)] if first else [[(f["at"], f["size"], f["fix"]) for f in x] for x in b.column(len(fields)).to_pylist()]
                for start, data, offsets, row, place, found in check._found(matcher, b.column(at), patterns, unicode, not binary):
                    for r, p, f in zip(row.tolist(), (place - offsets[row]).tolist() if len(found) else (), found, strict=True):
                        if len(f[4]) == 1:
                            held[start + r].append((p, len(f[2].encode()), f[4][0]))
                own = b.columns[: len(fields)]
                if not last:
                    yield pa.RecordBatch.from_arrays([*own, pa.array([[{"at": a, "size": n, "fix": f} for a, n, f in x] for x in held], to_arrow_type(_FIXES))], names=[*kept, "__fixes"])
                    continue
                changed = [i for i, x in enumerate(held) if x]
                texts, mask = b.column(at), np.zeros(b.num_rows, bool)
                mask[changed] = True
                done = [put(texts[i].as_py() if binary else texts[i].as_py().encode(), held[i]) for i in changed]
                new = pa.array(done if binary else [x.decode() for x in done], texts.type)
                yield pa.RecordBatch.from_arrays([*own, pc.replace_with_mask(texts, pa.array(mask), new), pa.array([len(x) for x in held], pa.int32())], names=[*kept, "fixed_text", "n_fixed"])

        return run

    out = rows
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        out = map_arrow(out, one(part, i == 0, last), StructType([*fields, *(ends if last else [StructField("__fixes", _FIXES)])]))
    return out


def unified_diff(before: Column, after: Column, old: Column, new: Column) -> Column:
    """A unified diff without context lines; empty if nothing changed."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        def one(a, b, x, y):
            if a is None or b is None or (a == b and x == y):
                return ""
            lines = difflib.unified_diff(a.splitlines(True), b.splitlines(True), x, y, n=0)
            return "".join(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n" for line in lines)

        return pd.Series([one(*r) for r in zip(a, b, x, y, strict=True)])

    return diff(before, after, old, new)


def diff_rows(fixed: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(path, diff) of the rows of :func:`fix_text` that changed."""
    ship(fixed.sparkSession)
    changed = fixed.where((F.col("n_fixed") > 0))
    return changed.select(path, unified_diff(F.col(text), F.col("fixed_text"), F.col(path).cast("string"), F.col(path).cast("string")).alias("diff"))
