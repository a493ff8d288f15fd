"""What becomes of findings: lines of text, JSON, SARIF, annotations, corrected files."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scan
from ..functions import tokens as T
from ..shipping import ship
from ..sources import files as files_


def message(typo: Column, status: Column, corrections: Column) -> Column:
    """`x` should be `a`, `b`; or: `x` is disallowed."""
    quoted = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    return F.when(status == "Invalid", F.concat(quoted(typo), F.lit(" is disallowed"))).otherwise(F.concat(quoted(typo), F.lit(" should be "), F.array_join(F.transform(corrections, quoted), ", ")))


def brief(found: DataFrame, path: str = "path") -> DataFrame:
    """One line a finding: path:line:column: message; names have no line."""
    place = F.when(F.col("line_num").isNull(), F.col(path).cast("string")).otherwise(F.concat_ws(":", F.col(path).cast("string"), "line_num", F.col("line_byte_offset") + 1))
    return found.select(F.concat_ws(": ", place, message(F.col("typo"), F.col("status"), F.col("corrections"))).alias("value"))


def json_lines(found: DataFrame, path: str = "path") -> DataFrame:
    """JSON lines with a type tag; corrections are null for what is disallowed."""
    fields = F.struct(
        F.lit("typo").alias("type"), F.col(path).alias("path"), "line_num", F.col("line_byte_offset").alias("byte_offset"), "typo",
        F.when(F.col("status") == "Corrections", F.col("corrections")).alias("corrections"),
    )
    return found.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def parse_lines(rows: DataFrame, kind: str, path: str = "path", text: str = "text", upper_hashes: bool = False) -> DataFrame:
    """JSON lines of a text's identifiers or words, in order; ``upper_hashes``: those of hashes in upper case too."""
    tokens = scan.identifiers_column(F.col(text), upper_hashes=upper_hashes)
    if kind == "words":
        tokens = F.flatten(F.transform(tokens, T.words))
    one = rows.select(F.col(path).alias("path"), F.posexplode(tokens).alias("pos", "data"))
    return one.select("path", "pos", F.to_json(F.struct(F.lit("parse").alias("type"), "path", F.lit(0).alias("line_num"), F.lit(kind.removesuffix("s")).alias("kind"), "data")).alias("value"))


#: What begins a piece: dim, and the two styles. What ends it.
_STYLES, _END = (b"\x1b[2m", b"\x1b[36m", b"\x1b[1;36m"), b"\x1b[0m"
_STYLE_BYTES = np.array([len(s) for s in _STYLES])


def _put(out: np.ndarray, at: np.ndarray, what: bytes) -> None:
    for i, byte in enumerate(what):
        out[at + i] = byte


def _painted(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, style: np.ndarray, cuts: Sequence[np.ndarray] = ()) -> pa.Array:
    """Rows with their tokens in a style (1 or 2), all else dim in pieces that end at ``cuts`` too."""
    edge = np.zeros(len(data) + 1, bool)
    for x in (start, end, offsets, *cuts):
        edge[x] = True
    edges = np.flatnonzero(edge)
    size = np.diff(edges)
    kind = np.zeros(len(size), np.int8)
    kind[np.searchsorted(edges, start)] = style
    before = _STYLE_BYTES[kind]
    begin = np.zeros(len(size) + 1, np.int64)
    np.cumsum(before + size + len(_END), out=begin[1:])
    out = np.empty(begin[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(begin[:-1] + before - edges[:-1], size)] = data
    for k, what in enumerate(_STYLES):
        _put(out, begin[:-1][kind == k], what)
    _put(out, begin[1:] - len(_END), _END)
    rows = begin[np.searchsorted(edges, offsets)].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(rows) - 1, [None, pa.py_buffer(rows), pa.py_buffer(out)])


def painted(texts: pa.Array, kind: str = "identifiers") -> pa.Array:
    """What :func:`highlight` gives, for a whole column; tokens are never looked at one by one but for
    the words of identifiers that aren't a plain one, once for each different one of a megabyte."""
    parts = []
    for _, _, data, offsets in scan.slabs(texts):
        start, end, plain = scan.of_rows(data, offsets)
        if kind == "words":
            first, last, nth = scan.words(data, start, end, plain)
            parts.append(_painted(data, offsets, first, last, 1 + nth % 2, (start, end)))
        else:
            at = np.searchsorted(start, offsets)
            nth = np.arange(len(start)) - np.repeat(at[:-1], np.diff(at))
            parts.append(_painted(data, offsets, start, end, 1 + nth % 2))
    out = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    return pc.if_else(texts.is_valid(), out, pa.scalar(None, pa.string())) if texts.null_count else out


def highlight(text: Column, kind: str = "identifiers") -> Column:
    """The text with its tokens in two alternating styles, all else dim; words alternate within their
    identifier."""
    ship(SparkSession.active())

    @F.arrow_udf("string")
    def shown(texts: pa.Array) -> pa.Array:
        return painted(texts, kind)

    return shown(text)


def sarif_results(found: DataFrame, path: str = "path") -> DataFrame:
    """(path, byte_offset, value): a SARIF result for each of the findings, which must have
    prefix_chars. Columns count code points from 1; names have no region and no fixes."""
    start = F.col("prefix_chars") + 1
    inside = F.col("line_num").isNotNull()
    region = F.when(inside, F.struct(F.col("line_num").alias("startLine"), F.col("line_num").alias("endLine"), start.alias("startColumn"), (start + F.length("typo")).alias("endColumn")))
    where = F.struct(F.col(path).cast("string").alias("uri"))
    said = F.struct(message(F.col("typo"), F.col("status"), F.col("corrections")).alias("markdown"))
    swaps = F.transform("corrections", lambda c: F.struct(region.alias("deletedRegion"), F.struct(c.alias("text")).alias("insertedContent")))
    fix = F.struct(said.alias("description"), F.array(F.struct(where.alias("artifactLocation"), swaps.alias("replacements"))).alias("artifactChanges"))
    place = F.struct(F.struct(where.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.lit("error").alias("level"), said.alias("message"), F.array(place).alias("locations"), F.when(inside & (F.col("status") == "Corrections"), F.array(fix)).alias("fixes"))
    return found.select(path, F.coalesce("line_num", F.lit(0)).alias("line_num"), "byte_offset", F.to_json(result).alias("value"))


def sarif(found: DataFrame, errors: Sequence[str] = (), path: str = "path") -> Iterator[str]:
    """The lines of one SARIF 2.1.0 document. Results come one partition after the other, in order of
    path and place, so the document never has to be in one place."""
    run = {"tool": {"driver": {"name": "glyphwright"}}, "columnKind": "unicodeCodePoints"}
    if errors:
        run["invocations"] = [{"executionSuccessful": False, "processStartFailureMessage": e} for e in errors]
    yield '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [' + json.dumps(run)[:-1] + ', "results": ['
    comma = ""
    for r in sarif_results(found, path).orderBy(path, F.col("line_num") == 0, "byte_offset").toLocalIterator():
        yield comma + r.value
        comma = ","
    yield "]}]}"


def annotations(found: DataFrame, path: str = "path") -> DataFrame:
    """Workflow commands that mark the places in a review."""
    text = message(F.col("typo"), F.col("status"), F.col("corrections"))
    return found.select(F.concat(F.lit("::warning file="), F.col(path).cast("string"), F.lit(",line="), F.coalesce("line_num", F.lit(1)), F.lit(",col="), F.col("line_byte_offset") + 1, F.lit("::"), text).alias("value"))


def long(found: DataFrame, path: str = "path") -> DataFrame:
    """A snippet a finding: message, place, the line, and marks under the typo. The findings must have
    line and prefix_chars."""
    number, before = F.col("line_num").cast("string"), F.col("prefix_chars").cast("int")
    pad = F.rpad(F.lit(""), F.length(number), " ")
    head = F.concat(F.lit("error: "), message(F.col("typo"), F.col("status"), F.col("corrections")))
    where = F.concat(pad, F.lit(" ┌─ "), F.col(path).cast("string"), F.lit(":"), number, F.lit(":"), (before + 1).cast("string"))
    return found.select(path, "byte_offset", F.concat_ws("\n", head, where, F.concat(pad, F.lit(" │")), F.concat(number, F.lit(" │ "), F.col("line")), F.concat(pad, F.lit(" │ "), F.rpad(F.lit(""), before, " "), F.rpad(F.lit(""), F.length("typo"), "^"))).alias("value"))


def write_fixed(fixed: DataFrame, path: str = "path", content_type: str = "content_type", text: str = "fixed_text") -> int:
    """Write corrected content (bytes) back to its files, in the encoding that they had, from the
    tasks. Returns how many were written. A text that has become empty isn't written to UTF-16 files."""
    ship(fixed.sparkSession)

    def write(batches):
        for b in batches:
            n = 0
            for where, data, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind.startswith("UTF_16") and not data:
                    continue
                Path(where).write_bytes(files_.encode(data.decode(), kind) if kind.startswith("UTF_16") else data)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32())], names=["n"])

    changed = fixed.where("n_fixed > 0").select(path, F.col(text).cast("binary").alias("data"), content_type)
    return changed.mapInArrow(write, "n int").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def renames(found: DataFrame, path: str = "path") -> DataFrame:
    """(path, new_path) of files whose names have misspellings with one correction."""
    names = found.where(F.col("line_num").isNull() & (F.size("corrections") == 1))
    fixes = names.groupBy(path).agg(F.collect_set(F.struct("byte_offset", "typo", F.col("corrections")[0].alias("fix"))).alias("fixes"))
    from .fix import splice

    name = F.element_at(F.split(path, "/"), -1)
    folder = F.substr(F.col(path), F.lit(1), F.length(path) - F.length(name))
    return fixes.select(path, F.concat(folder, splice(name, F.col("fixes"))).alias("new_path"))
