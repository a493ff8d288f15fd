import codecs

import pytest
from pyspark.sql import functions as F

from glyphwright.operators import check, fix, sinks
from glyphwright.sources import config, dictionaries, files


def _tree(root, names):
    for name, text in names.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def _walk(root, **walk):
    return sorted(p.removeprefix(f"{root}/") for p, _ in files.walk(str(root), config.Walk(**walk)))


def test_walk(tmp_path):
    _tree(tmp_path, {"a.txt": "", "_x.txt": "", ".hidden": "", "skip/b.txt": "", "skip/keep.txt": "", "c/d.log": "", ".gitignore": "*.log\n/skip/b.txt\n"})
    assert _walk(tmp_path) == ["_x.txt", "a.txt", "skip/keep.txt"]
    assert _walk(tmp_path, ignore_hidden=False, ignore_vcs=False) == [".gitignore", ".hidden", "_x.txt", "a.txt", "c/d.log", "skip/b.txt", "skip/keep.txt"]
    assert _walk(tmp_path, extend_exclude=("skip/",)) == ["_x.txt", "a.txt"]
    assert _walk(tmp_path, extend_exclude=("*.txt", "!a.txt")) == ["a.txt"]


def test_explicit_files(tmp_path):
    _tree(tmp_path, {"a.skip": ""})
    one = str(tmp_path / "a.skip")
    assert list(files.walk(one, config.Walk(extend_exclude=("*.skip",)))) == [(one, True)]
    assert list(files.walk(one, config.Walk(extend_exclude=("*.skip",)), force_exclude=True)) == []
    assert files.excluded(files.rules(["*", "!checked/**", "!checked/"]), "checked/file.txt") is False
    assert files.excluded(files.rules(["*", "!checked/**"]), "other/file.txt") is True


def test_git_ignore_of_the_user(tmp_path, monkeypatch):
    _tree(tmp_path, {"tree/a.txt": "", "tree/b.log": "", "tree/c.tmp": "", "config/git/ignore": "*.log\n", "own": "*.tmp\n"})
    monkeypatch.setenv("HOME", str(tmp_path))
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    assert _walk(tmp_path / "tree") == ["a.txt", "c.tmp"]
    (tmp_path / ".gitconfig").write_text("[user]\nname = x\n[core]\n\texcludesFile = ~/own\n")
    assert _walk(tmp_path / "tree") == ["a.txt", "b.log"] and len(_walk(tmp_path / "tree", ignore_vcs=False)) == 3
    assert len(_walk(tmp_path / "tree", ignore_global=False)) == 3


def test_decoding():
    assert files.decode(codecs.BOM_UTF16_LE + "né".encode("utf-16-le")) == ("né".encode(), "UTF_16LE", None)
    assert files.decode(b"a\0b") == (b"a\0b", "BINARY", None)
    assert files.decode(codecs.BOM_UTF32_LE + b"x\0\0\0")[1] == "BINARY"
    assert files.decode(codecs.BOM_UTF16_LE + b"x\0y")[2]
    assert files.encode("né", "UTF_16BE") == codecs.BOM_UTF16_BE + "né".encode("utf-16-be")


def test_read_check_and_write(spark, tmp_path):
    _tree(tmp_path, {"a.txt": "teh end", "glyphwright.toml": "", "sub/b.txt": "fine"})
    (tmp_path / "c.txt").write_bytes(codecs.BOM_UTF16_LE + "teh".encode("utf-16-le"))
    (tmp_path / "d.bin").write_bytes(b"\0 teh")
    (tmp_path / "e.txt").write_bytes(b"x\xe9 teh")
    read = files.read(spark, files.walk(str(tmp_path)))
    rows = files.checkable(read)
    lex = check.lexicon(spark, words={"teh": "the"})
    see = lambda df: sorted((r.path.rsplit("/", 1)[1], r.byte_offset) for r in check.findings(df, lex, "content", ["path"]).collect())
    assert see(rows) == [("a.txt", 0), ("c.txt", 0), ("e.txt", 3)]
    assert see(files.checkable(read, binary=True)) == [("a.txt", 0), ("c.txt", 0), ("d.bin", 2), ("e.txt", 3)]
    assert sinks.write_fixed(fix.fix_text(rows, lex, "content")) == 3
    assert (tmp_path / "a.txt").read_text() == "the end" and (tmp_path / "e.txt").read_bytes() == b"x\xe9 the" and (tmp_path / "d.bin").read_bytes() == b"\0 teh"
    assert (tmp_path / "c.txt").read_bytes() == codecs.BOM_UTF16_LE + "the".encode("utf-16-le")
    missing = files.read(spark, [(str(tmp_path / "none"), True)]).first()
    assert missing.error and missing.content == b""
    (tmp_path / "long.txt").write_text("x" * 5000)
    assert len(files.read(spark, [(str(tmp_path / "long.txt"), True)], head=True).first().content) == files.HEAD


def test_read_store(spark, tmp_path):
    _tree(tmp_path, {"a.txt": "teh", ".hidden/b.txt": "", "skip/c.txt": "", "d/e.txt": "é", "d/glyphwright.toml": "", ".keep": ""})
    read = files.read_store(spark, str(tmp_path), config.Walk(extend_exclude=("skip/",)))
    assert sorted(r.path.rsplit("/", 1)[1] for r in read.collect()) == ["a.txt", "e.txt"]
    assert check.findings(read, check.lexicon(spark, words={"teh": "the"}), "content", ["path"]).count() == 1


def test_retired_keys():
    with pytest.warns(FutureWarning, match="ignore-hex"):
        assert config.parse("[default]\nignore-hex = true").default == config.Engine()


def test_config_merging():
    c = config.parse('[default]\nlocale = "en-gb"\nextend-ignore-re = ["a"]\n[default.extend-words]\nteh = "teh"\n[type.py]\ncheck-file = false\nextend-glob = ["*.pyx"]\n')
    merged = config.BUILT_IN.merged(c).merged(config.parse('[default]\nextend-ignore-re = ["b"]\n[default.extend-words]\nhte = ""\n'))
    assert merged.default.extend_ignore_re == ("a", "b") and merged.default.extend_words == {"teh": "teh", "hte": ""}
    assert merged.engine("py").policy == {"binary": False, "check_filename": True, "check_file": False, "unicode": True, "locale": "en-gb"}
    assert merged.engine("cert").policy["check_file"] is False and merged.engine("rust").extend_words["ser"] == "ser"
    assert merged.globs() == {"py": ["*.pyx"]}
    walk = config.Walk(ignore_vcs=False).merged(config.Walk(ignore_files=True))
    assert walk.on("vcs") and not config.Walk(ignore_files=False).on("dot") and config.Walk(ignore_files=False).on("hidden")
    assert config.parse("[files]\nignore-hidden = false\n").files.on("hidden") is False
    again = config.parse(config.dump(merged))
    assert again.default.extend_words == merged.default.extend_words and again.types["py"].check_file is False


@pytest.mark.parametrize("text,said", [("nope = 1", "nope"), ("[default]\nnope = 1", "default.nope"), ("[type.x]\nnope = 1", "type.x.nope"), ("[files]\nnope = 1", "files.nope"), ('[default]\nextend-ignore-words-re = ["("]', "bad expression"), ("[default", ""), ('[default]\nlocale = "xx"', "locale")])
def test_bad_config(text, said):
    with pytest.raises(config.ConfigError, match=said.replace(".", r"\.")):
        config.parse(text)


def test_unknown_type_needs_a_glob():
    with pytest.raises(config.ConfigError):
        config.parse("[type.mine]\ncheck-file = true").globs()


def test_discovery(tmp_path):
    _tree(tmp_path, {"glyphwright.toml": '[default]\nlocale = "en-us"', "a/pyproject.toml": "[tool.other]\nx = 1", "b/pyproject.toml": '[tool.glyphwright.default]\nlocale = "en-ca"', "a/x/y.txt": ""})
    assert config.discover(tmp_path / "a" / "x").default.locale == "en-us"
    assert config.discover(tmp_path / "b").default.locale == "en-ca"
    assert config.discover(tmp_path / "b", isolated=True).default.locale is None


def test_lists(spark, tmp_path):
    _tree(tmp_path, {"r.csv": "teh,the\nhte,the,hate\nbad\n", "a.txt": "ther->there, their,\n", "i.json": '{"the": ["teh"], "ten": ["teh"]}', "w.csv": "Foo,a reason\nbar\n", "v.csv": "foo,another\n"})
    get = lambda df: {r.key: r.corrections for r in df.collect()}
    assert get(dictionaries.read_ragged(spark, str(tmp_path / "r.csv"))) == {"teh": ["the"], "hte": ["the", "hate"], "bad": []}
    assert get(dictionaries.read_arrows(spark, str(tmp_path / "a.txt"))) == {"ther": ["there", "their"]}
    assert get(dictionaries.read_inverted(spark, str(tmp_path / "i.json"))) == {"teh": ["ten", "the"]}
    both = dictionaries.allow_list(*[dictionaries.read_allowed(spark, str(tmp_path / n)) for n in ("w.csv", "v.csv")])
    assert {r.word: r.reason for r in both.collect()} == {"foo": "another", "bar": None}


def test_stream(spark, tmp_path):
    from glyphwright.streaming import stream

    spark.createDataFrame([("teh end",), ("Teh",)], "text string").write.parquet(str(tmp_path / "in"))
    got = stream.counts(spark, str(tmp_path / "in"), check.lexicon(spark, words={"teh": "the"}))
    assert [(r.typo, r.n) for r in got.collect()] == [("teh", 2)]
    assert F is not None
