"""Project configuration: TOML files, their merging, checking, and what follows for each file type."""

from __future__ import annotations

import re
import tomllib
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from ..operators.filetypes import DEFAULT_TYPES

#: The name that a project's configuration goes by: in names of files and as the table in a manifest.
#: Another tool's configuration of the same form is read by giving its name to the functions below.
TOOL = "glyphwright"
MANIFESTS = ("Cargo.toml", "pyproject.toml")
LOCALES = ("en", *(f"en-{country}" for country in ("us", "gb", "ca", "au")))
UNCHECKED = ("cert", "lock")
#: Names that are right in the code of one language.
TYPE_IDENTIFIERS = {
    "cpp": ["countr_one"], "css": ["nd"], "man": ["Nd"], "rust": ["flate2", "ratatui"], "vimscript": ["windo"], "sh": ["ot", "stap"],
    "py": ["NDArray", "EOFError", "arange", "certifi"],
    "go": ["flate", "Rela32", "Rela64", "NewCBCEncrypter", "NewCFBEncrypter", "O_WRONLY", "NOTE_FFOR", "TLS_ECDHE_RSA_WITH_3DES_EDE_CBC_SHA", "TLS_RSA_WITH_3DES_EDE_CBC_SHA"],
}
TYPE_WORDS = {"bitbake": ["PN"], "jl": ["egal", "egals", "modul", "usig"], "rust": ["ser"]}


def file_names(tool: str = TOOL) -> tuple[str, ...]:
    return (f"{tool}.toml", f"_{tool}.toml", f".{tool}.toml", *MANIFESTS)


class ConfigError(ValueError):
    """code: the exit status that goes with it."""

    code = 78


def _key(name: str) -> str:
    return name.replace("_", "-")


@dataclass(frozen=True)
class Walk:
    extend_exclude: tuple[str, ...] = ()
    ignore_hidden: bool | None = None
    ignore_files: bool | None = None
    ignore_dot: bool | None = None
    ignore_vcs: bool | None = None
    ignore_global: bool | None = None
    ignore_parent: bool | None = None

    def merged(self, other: Walk) -> Walk:
        """What ``other`` says counts; saying ignore-files resets the finer switches."""
        base = self
        if other.ignore_files is not None:
            base = replace(base, ignore_files=other.ignore_files, ignore_dot=None, ignore_vcs=None, ignore_global=None, ignore_parent=None)
        if other.ignore_vcs is not None:
            base = replace(base, ignore_global=None)
        said = {f.name: v for f in fields(other) if f.name != "extend_exclude" and (v := getattr(other, f.name)) is not None}
        return replace(base, **said, extend_exclude=base.extend_exclude + other.extend_exclude)

    def on(self, name: str) -> bool:
        value = getattr(self, f"ignore_{name}")
        if name == "global" and value is None:
            value = self.ignore_vcs
        if value is None and name != "hidden":
            value = self.ignore_files
        return True if value is None else value


@dataclass(frozen=True)
class Engine:
    binary: bool | None = None
    check_filename: bool | None = None
    check_file: bool | None = None
    unicode: bool | None = None
    locale: str | None = None
    extend_ignore_re: tuple[str, ...] = ()
    extend_ignore_identifiers_re: tuple[str, ...] = ()
    extend_ignore_words_re: tuple[str, ...] = ()
    extend_identifiers: Mapping[str, str] = field(default_factory=dict)
    extend_words: Mapping[str, str] = field(default_factory=dict)
    extend_glob: tuple[str, ...] = ()

    def merged(self, other: Engine) -> Engine:
        """Single values: the last one said; lists and tables: all of them."""
        out = {}
        for f in fields(self):
            a, b = getattr(self, f.name), getattr(other, f.name)
            out[f.name] = a + b if isinstance(a, tuple) else {**a, **b} if isinstance(a, Mapping) else a if b is None else b
        return Engine(**out)

    @property
    def policy(self) -> dict[str, bool | str]:
        defaults = {"binary": False, "check_filename": True, "check_file": True, "unicode": True, "locale": "en"}
        return {k: v if (v := getattr(self, k)) is not None else d for k, d in defaults.items()}


@dataclass(frozen=True)
class Config:
    files: Walk = field(default_factory=Walk)
    default: Engine = field(default_factory=Engine)
    types: Mapping[str, Engine] = field(default_factory=dict)
    overrides: Engine = field(default_factory=Engine)

    def merged(self, other: Config) -> Config:
        names = [*self.types, *(t for t in other.types if t not in self.types)]
        types = {n: self.types.get(n, Engine()).merged(other.types.get(n, Engine())) for n in names}
        return Config(self.files.merged(other.files), self.default.merged(other.default), types, self.overrides.merged(other.overrides))

    def globs(self) -> dict[str, list[str]]:
        """A project's own globs by type; a type that nobody knows must have some."""
        for name, engine in self.types.items():
            if not engine.extend_glob and name not in DEFAULT_TYPES:
                raise ConfigError(f"unknown type `{name}` without a glob")
        return {n: list(e.extend_glob) for n, e in self.types.items() if e.extend_glob}

    def engine(self, file_type: str | None) -> Engine:
        """What holds for files of a type: defaults, built in for the type, the type's own, overrides."""
        built_in = Engine(
            check_file=False if file_type in UNCHECKED else None,
            extend_identifiers={i: i for i in TYPE_IDENTIFIERS.get(file_type or "", ())},
            extend_words={w: w for w in TYPE_WORDS.get(file_type or "", ())},
        )
        own = self.types.get(file_type or "", Engine())
        return self.default.merged(built_in).merged(own).merged(self.overrides)

    def policies(self) -> list[tuple]:
        """(file_type, binary, check_filename, check_file, unicode, locale) of every type, and of none."""
        names = [None, *sorted({*DEFAULT_TYPES, *self.types})]
        return [(n, *self.engine(n).policy.values()) for n in names]


BUILT_IN = Config()
_RETIRED = ("ignore-hex", "identifier-leading-digits", "identifier-ignore-hex")


def _fill(kind, table: Mapping[str, Any], where: str):
    known = {_key(f.name): f.name for f in fields(kind)}
    out = {}
    for k, v in table.items():
        if k in _RETIRED:
            warnings.warn(f"`{where}.{k}` has no effect any more", FutureWarning, stacklevel=3)
            continue
        if k not in known:
            raise ConfigError(f"unknown key `{where}.{k}`")
        if k == "locale" and v not in LOCALES:
            raise ConfigError(f"unknown locale `{v}`")
        if k.endswith("-re"):
            for p in v:
                try:
                    re.compile(re.sub(r"^\(\?([a-zA-Z]*)R([a-zA-Z]*)\)", lambda m: f"(?{m[1]}{m[2]})" if m[1] + m[2] else "", p))
                except re.error as e:
                    raise ConfigError(f"bad expression `{p}`: {e}") from e
        out[known[k]] = tuple(v) if isinstance(v, list) else v
    return kind(**out)


def parse(text: str, name: str = "", tool: str = TOOL) -> Config | None:
    """A configuration; None if a manifest has none in it."""
    try:
        table = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    if name == "Cargo.toml":
        meta = [table.get(k, {}).get("metadata", {}).get(tool) for k in ("workspace", "package")]
        table = next((m for m in meta if m is not None), None)
    elif name == "pyproject.toml":
        table = table.get("tool", {}).get(tool)
    if table is None:
        return None
    for k in table:
        if k not in ("files", "default", "type", "overrides"):
            raise ConfigError(f"unknown key `{k}`")
    types = {n: _fill(Engine, t, f"type.{n}") for n, t in table.get("type", {}).items()}
    return Config(_fill(Walk, table.get("files", {}), "files"), _fill(Engine, table.get("default", {}), "default"), types, _fill(Engine, table.get("overrides", {}), "overrides"))


def load_dir(folder: Path, tool: str = TOOL) -> Config | None:
    """The first usable configuration of a folder, in the order of :func:`file_names`."""
    for name in file_names(tool):
        p = folder / name
        if p.is_file() and (found := parse(p.read_text(encoding="utf-8"), name, tool)) is not None:
            return found
    return None


def discover(start: Path, isolated: bool = False, extra: Config | None = None, tool: str = TOOL) -> Config:
    """The nearest configuration at or above ``start``, with ``extra`` on top."""
    found = None
    if not isolated:
        start = start.resolve()
        for folder in (start, *start.parents):
            if (found := load_dir(folder, tool)) is not None:
                break
    out = BUILT_IN.merged(found) if found else BUILT_IN
    return out.merged(extra) if extra else out


def dump(config: Config) -> str:
    """The effective configuration as TOML, defaults filled in."""

    def value(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(value(x) for x in v) + "]"
        return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

    def engine(e: Engine, defaults: bool):
        rows = [f"{_key(k)} = {value(v)}" for k, v in ((e.policy if defaults else {k: getattr(e, k) for k in e.policy if getattr(e, k) is not None}).items())]
        rows += [f"{_key(f.name)} = {value(getattr(e, f.name))}" for f in fields(e) if isinstance(getattr(e, f.name), tuple) and getattr(e, f.name)]
        tables = [(_key(k), t) for k in ("extend_identifiers", "extend_words") if (t := getattr(e, k))]
        return rows, tables

    lines = ["[files]", *[f"{_key(f.name)} = {value(config.files.on(f.name[7:]))}" for f in fields(Walk) if f.name != "extend_exclude"], f"extend-exclude = {value(config.files.extend_exclude)}"]
    for head, e, full in (("default", config.default.merged(config.overrides), True), *((f"type.{n}", t, False) for n, t in sorted(config.types.items()))):
        rows, tables = engine(e, full)
        lines += ["", f"[{head}]", *rows]
        for name, t in tables:
            lines += ["", f"[{head}.{name}]", *[f"{value(k)} = {value(v)}" for k, v in t.items()]]
    return "\n".join(lines) + "\n"
