"""Source trees: which files to read, by ignore rules, and what is in them.

Paths are listed where the tree is (pruning whole folders), contents are read by the tasks.
"""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filetypes import glob_regex
from ..shipping import ship
from .config import TOOL, Walk, file_names


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file: matches relative paths; the last match of a list decides."""

    regex: re.Pattern
    keep: bool
    folders_only: bool

    @classmethod
    def of(cls, line: str) -> Rule | None:
        line = line.rstrip("\n").rstrip("\r")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            return None
        keep = line.startswith("!")
        line = line[1:] if keep else line
        line = line[1:] if line.startswith(("\\#", "\\!")) else line
        folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        body = ""
        for i, part in enumerate(line.split("/")):
            last = i == line.count("/")
            if part == "**":
                body += ".*" if last else "(?:.*/)?"
            else:
                body += glob_regex(part.replace("**", "*")) + ("" if last else "/")
        return cls(re.compile(f"^{'' if anchored else '(?:.*/)?'}{body}$"), keep, folders)


def rules(lines: Iterable[str]) -> list[Rule]:
    return [r for line in lines if (r := Rule.of(line)) is not None]


def verdict(own: Sequence[Rule], path: str, folder: bool) -> bool | None:
    """True: kept by name; False: ignored; None: not mentioned."""
    for r in reversed(own):
        if (folder or not r.folders_only) and r.regex.match(path):
            return r.keep
    return None


def excluded(own: Sequence[Rule], path: str, folder: bool = False) -> bool:
    """Whether a path or one of its folders, from the top, is ignored; being kept by name ends the search."""
    parts = path.split("/")
    for i in range(1, len(parts) + 1):
        v = verdict(own, "/".join(parts[:i]), folder or i < len(parts))
        if v is False:
            return True
    return False


def _ignore_files(folder: Path, walk: Walk) -> list[Rule]:
    names = ([".gitignore"] if walk.on("vcs") else []) + ([".ignore"] if walk.on("dot") else [])
    out: list[Rule] = []
    if walk.on("vcs") and (p := folder / ".git" / "info" / "exclude").is_file():
        out += rules(p.read_text(errors="replace").splitlines())
    for n in names:
        if (p := folder / n).is_file():
            out += rules(p.read_text(errors="replace").splitlines())
    return out


def global_ignore_file() -> Path | None:
    """The file of git's user-wide ignore rules: core.excludesFile, else the usual place."""
    home = Path(os.path.expanduser("~"))
    base = Path(os.environ.get("XDG_CONFIG_HOME") or home / ".config")
    for p in (home / ".gitconfig", base / "git" / "config"):
        if p.is_file():
            section = ""
            for line in p.read_text(errors="replace").splitlines():
                if found := re.match(r"\s*\[([^\]]*)\]", line):
                    section = found[1].strip().lower()
                elif section == "core" and (found := re.match(r"\s*excludesfile\s*=\s*\"?([^\"]+?)\"?\s*$", line, re.IGNORECASE)):
                    return Path(os.path.expanduser(found[1]))
    return base / "git" / "ignore"


def walk(root: str, config: Walk | None = None, force_exclude: bool = False) -> Iterator[tuple[str, bool]]:
    """(path, explicit) of the files at or under ``root``, in order of name. A file that is named
    itself is explicit and only left out by ``force_exclude``."""
    config = config or Walk()
    top = Path(root)
    own = rules(config.extend_exclude)
    if top.is_file():
        if not (force_exclude and excluded(own, str(root).removeprefix("./"))):
            yield root, not force_exclude
        return
    stack: list[tuple[Path, list[tuple[Path, list[Rule]]]]] = []
    inherited = []
    if config.on("global") and (p := global_ignore_file()) is not None and p.is_file():
        inherited.append((top.resolve(), rules(p.read_text(errors="replace").splitlines())))
    if config.on("parent"):
        for p in reversed(top.resolve().parents):
            if found := _ignore_files(p, config):
                inherited.append((p, found))
    stack.append((top, inherited))
    while stack:
        folder, above = stack.pop()
        levels = [*above, (folder.resolve(), _ignore_files(folder, config))]
        folders = []
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            inside = entry.is_dir(follow_symlinks=False)
            path = Path(folder, entry.name)
            relative = path.relative_to(top).as_posix()
            mine = verdict(own, relative, inside)
            if mine is False or (mine is None and _left_out(levels, path, inside, entry.name, config)):
                continue
            if inside:
                folders.append(path)
            elif entry.is_file(follow_symlinks=False):
                yield str(path), False
        stack += [(f, levels) for f in reversed(folders)]


def _left_out(levels, path: Path, inside: bool, name: str, config: Walk) -> bool:
    whole = path.resolve() if not path.is_symlink() else path.absolute()
    for folder, own in reversed(levels):
        try:
            relative = whole.relative_to(folder).as_posix()
        except ValueError:
            continue
        v = verdict(own, relative, inside)
        if v is not None:
            return not v
    return config.on("hidden") and name.startswith(".")


def from_list(lines: Iterable[str]) -> list[str]:
    """Paths of a file list, one a line."""
    return [x for line in lines if (x := line.rstrip("\r\n"))]


_MARKS = [(codecs.BOM_UTF8, "UTF_8_BOM"), (codecs.BOM_UTF32_LE, "UTF_32LE"), (codecs.BOM_UTF32_BE, "UTF_32BE"), (codecs.BOM_UTF16_LE, "UTF_16LE"), (codecs.BOM_UTF16_BE, "UTF_16BE")]
_SIGNS = (b"%PDF", b"\x89PNG", b"GIF8", b"\xff\xd8\xff", b"PK\x03\x04", b"\x7fELF")


def content_type(data: bytes) -> str:
    """By byte order mark, known signs, and a zero byte at the beginning."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name
    if data.startswith(_SIGNS) or b"\0" in data[:1024]:
        return "BINARY"
    return "UTF_8"


def decode(data: bytes) -> tuple[bytes, str, str | None]:
    """(content to be checked, content type, error). UTF-16 becomes UTF-8 without its mark; UTF-32
    counts as binary."""
    kind = content_type(data)
    if kind in ("UTF_16LE", "UTF_16BE"):
        try:
            return data[2:].decode(kind.replace("_", "-").lower()).encode(), kind, None
        except UnicodeDecodeError as e:
            return data[2:].decode(kind.replace("_", "-").lower(), "replace").encode("utf-8", "replace"), kind, str(e)
    return data, "BINARY" if kind.startswith("UTF_32") else kind, None


def encode(text: str, kind: str) -> bytes:
    """Text as the content type had it."""
    if kind in ("UTF_16LE", "UTF_16BE"):
        mark = dict((n, m) for m, n in _MARKS)[kind]
        return mark + text.encode(kind.replace("_", "-").lower())
    return text.encode("utf-8")


SCHEMA = "path string, explicit boolean, content binary, content_type string, error string"
#: Bytes that tell whether a file is binary.
HEAD = 1024


def read(spark: SparkSession, paths: Iterable[tuple[str, bool]], batch: int = 256, tool: str = TOOL, head: bool = False) -> DataFrame:
    """The files as rows of SCHEMA, in tasks of ``batch`` files; content is as it is to be checked, UTF-16
    in UTF-8. What can't be read has an error and no content. Configuration files are left out.
    ``head``: content is no more than what tells its type."""
    ship(spark)
    rows = [(p, bool(e)) for p, e in paths if Path(p).name not in file_names(tool)]
    listed = spark.createDataFrame(rows, "path string, explicit boolean")
    listed = listed.repartition(max(1, -(-len(rows) // batch)))

    def load(batches):
        for b in batches:
            out, held = [], 0
            for path, explicit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    with open(path, "rb") as f:
                        data = f.read(HEAD) if head else f.read()
                    out.append((path, explicit, *((data, content_type(data), None) if head else decode(data))))
                except OSError as e:
                    out.append((path, explicit, b"", "UTF_8", str(e)))
                held += len(out[-1][2])
                if held > OUT_BYTES:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return listed.mapInArrow(load, SCHEMA)


def read_store(spark: SparkSession, root: str, config: Walk | None = None, tool: str = TOOL) -> DataFrame:
    """The files under ``root`` in any store that Spark reads, as rows of SCHEMA, listed and read by
    Spark. The configuration's own rules leave files out; ignore files in the tree aren't read. Spark
    itself never lists names that begin with a dot or an underscore."""
    ship(spark)
    config = config or Walk()
    own, names = rules(config.extend_exclude), file_names(tool)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")

    def left_out(path: str) -> bool:
        relative = path.split(base, 1)[-1].lstrip("/")
        return relative.rsplit("/", 1)[-1] in names or excluded(own, relative)

    def load(batches):
        for b in batches:
            rows = [(p, False, *decode(c)) for p, c in zip(*(x.to_pylist() for x in b.columns), strict=True) if not left_out(p)]
            if rows:
                yield _batch(rows)

    return found.mapInArrow(load, SCHEMA)


#: Bytes of content that a task hands on at a time.
OUT_BYTES = 16 << 20


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.bool_(), pa.binary(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "explicit", "content", "content_type", "error"])


def text_of(content: Column) -> Column:
    """Content as text, null unless it's UTF-8 throughout."""
    return F.try_validate_utf8(content.cast("string"))


def checkable(files: DataFrame, binary: bool = False) -> DataFrame:
    """Leave out binary files unless they are explicit or wanted."""
    return files.where((F.col("content_type") != "BINARY") | F.col("explicit") | F.lit(binary))
