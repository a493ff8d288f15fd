"""The command line: find, fix, list and report over source trees."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import check, filetypes, fix, sinks
from .sources import config, dictionaries, files, seed

MODES = ("files", "file_types", "highlight_identifiers", "identifiers", "highlight_words", "words", "write_changes", "diff")


class BadArguments(Exception):
    code = 64


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise BadArguments(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="glyphwright", description=__doc__)
    p.add_argument("path", nargs="*", default=[])
    p.add_argument("--file-list")
    p.add_argument("--config", "-c")
    p.add_argument("--config-name", default=config.TOOL, help="the name in the configuration's file or table")
    p.add_argument("--isolated", action="store_true")
    p.add_argument("--dictionary", help="typo,correction[,...] lines; without it the built-in list serves")
    p.add_argument("--sort", action="store_true", help="findings are always in order")
    p.add_argument("--threads", "-j", type=int, default=0, help="cores of a local session; 0: all")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--force-exclude", action="store_true")
    p.add_argument("--locale", choices=config.LOCALES)
    p.add_argument("--format", choices=("silent", "brief", "long", "json", "sarif", "annotations"), default="long")
    p.add_argument("--dump-config")
    p.add_argument("--type-list", action="store_true")
    for mode in MODES:
        p.add_argument(f"--{mode.replace('_', '-')}", action="store_true")
    for name in ("binary", "check_filenames", "check_files", "unicode", "hidden", "ignore", "ignore_dot", "ignore_global", "ignore_parent", "ignore_vcs"):
        p.add_argument(f"--{name.replace('_', '-')}", dest=name, action="store_true", default=None)
        p.add_argument(f"--no-{name.replace('_', '-')}", dest=name, action="store_false")
    return p


def overrides(args: argparse.Namespace) -> config.Config:
    walk = config.Walk(
        extend_exclude=tuple(args.exclude), ignore_hidden=None if args.hidden is None else not args.hidden, ignore_files=args.ignore,
        ignore_dot=args.ignore_dot, ignore_global=args.ignore_global, ignore_parent=args.ignore_parent, ignore_vcs=args.ignore_vcs,
    )
    return config.Config(files=walk, overrides=config.Engine(binary=args.binary, check_filename=args.check_filenames, check_file=args.check_files, unicode=args.unicode, locale=args.locale))


def resolve(args: argparse.Namespace, start: Path) -> config.Config:
    extra = overrides(args)
    if args.config:
        path = Path(args.config)
        if not path.is_file():
            raise config.ConfigError(f"no such file: {path}")
        extra = (config.parse(path.read_text(encoding="utf-8"), path.name, args.config_name) or config.BUILT_IN).merged(extra)
    return config.discover(start, args.isolated, extra, args.config_name)


def typed(rows: DataFrame, settings: config.Config) -> DataFrame:
    """With file_type, by the project's globs and the built-in ones."""
    return rows.withColumn("file_type", filetypes.file_type(F.col("path"), own=settings.globs()))


def groups(rows: DataFrame, settings: config.Config) -> Iterator[tuple[DataFrame, config.Engine]]:
    """The rows by what holds for their types; types that have the same rules come together."""
    present = {r.file_type for r in rows.select("file_type").distinct().collect()}
    by: dict[str, tuple[config.Engine, list[str | None]]] = {}
    for name in sorted(present, key=str) or [None]:
        e = settings.engine(name)
        key = repr((e.policy, e.extend_ignore_re, e.extend_ignore_identifiers_re, e.extend_ignore_words_re, sorted(e.extend_identifiers.items()), sorted(e.extend_words.items())))
        by.setdefault(key, (e, []))[1].append(name)
    for e, names in by.values():
        wanted = F.coalesce(F.col("file_type").isin([n for n in names if n is not None]), F.lit(False))
        yield files.checkable(rows.where(wanted | F.col("file_type").isNull() if None in names else wanted), e.policy["binary"]), e


def lexicon(spark: SparkSession, e: config.Engine, dictionary=None, compiled: DataFrame | None = None) -> check.Lexicon:
    return check.lexicon(spark, dictionary, compiled, e.policy["locale"], e.extend_words, e.extend_identifiers, e.extend_ignore_identifiers_re, e.extend_ignore_words_re)


def findings(rows: DataFrame, settings: config.Config, dictionary=None, compiled: DataFrame | None = None, placed: Sequence[str] = ()) -> DataFrame:
    """Findings in names and contents, each type of file by its own rules."""
    return reduce(DataFrame.unionByName, [
        check.check_files(own, lexicon(rows.sparkSession, e, dictionary, compiled), text="content", ignore=e.extend_ignore_re, names=e.policy["check_filename"], contents=e.policy["check_file"], unicode=e.policy["unicode"], placed=placed)
        for own, e in groups(rows, settings)
    ])


def fixed(rows: DataFrame, settings: config.Config, dictionary=None, compiled: DataFrame | None = None) -> DataFrame:
    """``rows`` with fixed_text (bytes) and n_fixed."""
    parts = []
    for own, e in groups(rows, settings):
        if e.policy["check_file"]:
            parts.append(fix.fix_text(own, lexicon(rows.sparkSession, e, dictionary, compiled), "content", e.extend_ignore_re, e.policy["unicode"]))
        else:
            parts.append(own.select("*", F.col("content").alias("fixed_text"), F.lit(0).alias("n_fixed")))
    return reduce(DataFrame.unionByName, parts)


def plan(args: argparse.Namespace, paths: Sequence[str]) -> list[tuple[config.Config, list[tuple[str, bool]]]]:
    """The files by their configuration: that of the nearest folder at or above a file of those that
    were arguments, up to its own, or had one as a file in them."""
    known: dict[Path, config.Config] = {}
    nearest: dict[Path, config.Config] = {}
    by: dict[str, tuple[config.Config, list[tuple[str, bool]]]] = {}
    for p in paths:
        start = (Path.cwd() if p == "-" else Path(p) if Path(p).is_dir() else Path(p).parent).resolve()
        if start not in known:
            known[start] = resolve(args, start)
            known[start].globs()
            nearest.clear()
        for path, explicit in [("-", True)] if p == "-" else files.walk(p, known[start].files, args.force_exclude):
            folder = start if p == "-" else Path(path).resolve().parent
            if folder not in nearest:
                nearest[folder] = next((known[f] for f in (folder, *folder.parents) if f in known), known[start])
            settings = nearest[folder]
            by.setdefault(repr(settings), (settings, []))[1].append((path, explicit))
    return list(by.values())


def _read(args, spark, listed, head=False) -> DataFrame:
    rows = files.read(spark, [x for x in listed if x[0] != "-"], tool=args.config_name, head=head)
    if any(p == "-" for p, _ in listed):
        data, kind, error = files.decode(getattr(sys.stdin, "buffer", None).read() if hasattr(sys.stdin, "buffer") else sys.stdin.read().encode())
        rows = rows.unionByName(spark.createDataFrame([("-", True, data, kind, error)], files.SCHEMA))
    return rows


def run(argv: Sequence[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    """The exit status: 0 clean, 2 findings, 1 errors, 64 bad arguments, 78 bad configuration."""
    try:
        args = parser().parse_args(argv)
        if args.path and args.file_list:
            raise BadArguments("--file-list and paths exclude each other")
        paths = args.path or ["."]
        if args.file_list:
            lines = sys.stdin if args.file_list == "-" else Path(args.file_list).read_text(encoding="utf-8").splitlines()
            paths = files.from_list(lines)
            if "-" in paths:
                raise BadArguments("a list of files can't have standard input in it")
        for p in paths:
            if p != "-" and not Path(p).exists():
                raise BadArguments(f"no such path: {p}")
        if args.dump_config or args.type_list:
            first = Path(paths[0]) if paths and paths[0] != "-" else Path(".")
            settings = resolve(args, first if first.is_dir() else first.parent)
            settings.globs()
        else:
            planned = plan(args, paths)
    except (BadArguments, config.ConfigError) as e:
        print(f"error: {e}", file=sys.stderr)
        return e.code
    say = lambda df: [print(r[0], file=out) for r in df.toLocalIterator()]
    if args.dump_config:
        text = config.dump(settings)
        print(text, file=out) if args.dump_config == "-" else Path(args.dump_config).write_text(text)
        return 0
    spark = spark or SparkSession.builder.master(f"local[{args.threads or '*'}]").getOrCreate()
    if args.type_list:
        globs = spark.createDataFrame(filetypes.ranked(filetypes.DEFAULT_TYPES, settings.globs()), "type string, glob string, rank int")
        say(filetypes.type_list(globs).orderBy("type").select(F.concat_ws(": ", "type", "globs")))
        return 0
    status = 0
    for settings, listed in planned:
        rows = typed(_read(args, spark, listed, head=args.files or args.file_types), settings)
        plain = files.checkable(rows, bool(settings.engine(None).policy["binary"]))
        text = files.text_of(F.col("content"))
        if args.files:
            say(plain.orderBy("path").select("path"))
        elif args.file_types:
            say(plain.orderBy("path").select(F.concat_ws(":", "path", F.coalesce("file_type", F.lit("-")))))
        elif args.highlight_identifiers or args.highlight_words:
            shown = plain.withColumn("text", text).where("text is not null").orderBy("path")
            say(shown.select(sinks.highlight(F.col("text"), "identifiers" if args.highlight_identifiers else "words")))
        elif args.identifiers or args.words:
            say(sinks.parse_lines(plain.withColumn("text", text), "identifiers" if args.identifiers else "words").orderBy("path", "pos").select("value"))
        else:
            one = _check(args, settings, rows, spark, say, out)
            status = 1 if 1 in (one, status) else max(one, status)
    return status


def _check(args, settings, rows, spark, say, out) -> int:
    dictionary = dictionaries.read_ragged(spark, args.dictionary) if args.dictionary else seed.dictionary()
    local = {settings.engine(t).policy["locale"] for t in (None, *settings.types)}
    compiled = seed.dialects(spark) if local != {"en"} else None
    errors = [(r.path, r.error) for r in rows.where("error is not null").select("path", "error").collect()]
    found = findings(rows, settings, dictionary, compiled, placed={"long": ["line", "prefix_chars"], "sarif": ["prefix_chars"]}.get(args.format, ()))
    if args.write_changes or args.diff:
        changed = fixed(rows, settings, dictionary, compiled)
        if args.diff:
            diffs = changed.select("path", F.col("content").cast("string").alias("text"), F.col("fixed_text").cast("string").alias("fixed_text"), "n_fixed")
            say(fix.diff_rows(diffs, "path").orderBy("path").select("diff"))
        else:
            say(changed.where("path = '-'").select(F.col("fixed_text").cast("string")))
            left = [r.asDict() for r in found.where(~check.is_fixable(F.col("corrections"))).groupBy().agg(F.count("*").alias("n")).collect()]
            moves = sinks.renames(found).collect() if not any(p == "-" for p in args.path) else []
            sinks.write_fixed(changed.where("path <> '-'"))
            for r in moves:
                Path(r.path).rename(r.new_path)
            return _status(errors, left[0]["n"] > 0)
        return _status(errors, bool(found.limit(1).count()))
    ordered = found.orderBy("path", F.col("line_num").isNotNull(), "byte_offset")
    if args.format == "brief":
        say(sinks.brief(ordered))
    elif args.format == "long":
        say(sinks.brief(ordered.where("line_num is null")))
        say(sinks.long(found.where("line_num is not null")).orderBy("path", "byte_offset").select("value"))
    elif args.format == "json":
        say(sinks.json_lines(ordered))
    elif args.format == "sarif":
        for line in sinks.sarif(found, [f"{p}: {e}" for p, e in errors]):
            print(line, file=out)
    elif args.format == "annotations":
        say(sinks.annotations(ordered))
    return _status(errors, bool(found.limit(1).count()))


def _status(errors, any_typo: bool) -> int:
    for path, e in errors:
        print(f"error: {path}: {e}", file=sys.stderr)
    return 1 if errors else 2 if any_typo else 0


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
