import io
import json

from glyphwright import cli


def _run(spark, *argv):
    out = io.StringIO()
    return cli.run([str(a) for a in argv], spark, out), out.getvalue()


def _tree(root):
    (root / "glyphwright.toml").write_text('[default.extend-words]\nteh = "the"\nbad = ""\n[type.md]\nextend-glob = ["*.md"]\ncheck-file = false\n[files]\nextend-exclude = ["skip/"]\n')
    for name, text in {"a.txt": "ok\nteh bad\n", "b.md": "teh", "skip/c.txt": "teh", "teh.py": "x = 1\n"}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)


def test_reports_and_exit_status(spark, tmp_path):
    _tree(tmp_path)
    code, text = _run(spark, tmp_path, "--format", "brief")
    assert code == 2 and text.splitlines() == [f"{tmp_path}/a.txt:2:1: `teh` should be `the`", f"{tmp_path}/a.txt:2:5: `bad` is disallowed", f"{tmp_path}/teh.py: `teh` should be `the`"]
    code, text = _run(spark, tmp_path, "--format", "json", "--no-check-filenames")
    assert [json.loads(x)["typo"] for x in text.splitlines()] == ["teh", "bad"]
    assert "^^^" in _run(spark, tmp_path / "a.txt")[1]
    (tmp_path / "none.csv").write_text("zzzz,zz\n")
    assert _run(spark, tmp_path, "--isolated", "--format", "silent", "--dictionary", tmp_path / "none.csv", "--exclude", "none.csv") == (0, "")
    assert _run(spark, tmp_path, "--isolated", "--format", "brief", "--no-check-filenames")[1].count("`teh` should be `the`") == 3  # the built-in list


def test_lists(spark, tmp_path):
    _tree(tmp_path)
    assert [x.rsplit("/", 1)[1] for x in _run(spark, tmp_path, "--files")[1].split()] == ["a.txt", "b.md", "teh.py"]
    assert [x.rsplit("/", 1)[1] for x in _run(spark, tmp_path, "--file-types")[1].split()] == ["a.txt:txt", "b.md:md", "teh.py:py"]
    assert "py: *.py, *.pyi, pyproject.toml" in _run(spark, tmp_path, "--type-list")[1]
    assert 'locale = "en-gb"' in _run(spark, tmp_path, "--dump-config", "-", "--locale", "en-gb")[1]
    assert '"data":"teh"' in _run(spark, tmp_path / "a.txt", "--identifiers")[1]


def test_changes(spark, tmp_path):
    _tree(tmp_path)
    assert "-teh bad\n+the bad" in _run(spark, tmp_path, "--diff")[1]
    assert _run(spark, tmp_path, "--write-changes")[0] == 2
    assert (tmp_path / "a.txt").read_text() == "ok\nthe bad\n" and (tmp_path / "b.md").read_text() == "teh" and (tmp_path / "the.py").exists()


def test_bad_calls(spark, tmp_path):
    assert _run(spark, tmp_path, "--nope")[0] == 64 and _run(spark, tmp_path / "none")[0] == 64
    assert _run(spark, tmp_path, "--file-list", "x")[0] == 64
    assert _run(spark, tmp_path, "--config", tmp_path / "none.toml")[0] == 78
    (tmp_path / "glyphwright.toml").write_text("[default]\nnope = 1")
    assert _run(spark, tmp_path)[0] == 78
    (tmp_path / "list").write_text(f"{tmp_path}/list\n")
    assert _run(spark, "--file-list", tmp_path / "list", "--isolated", "--files")[1].split() == [f"{tmp_path}/list"]


def _brief(spark, *argv):
    code, text = _run(spark, *argv, "--format", "brief", "--no-check-filenames")
    return code, sorted(x.rsplit("/", 1)[1] for x in text.splitlines())


def test_content_that_isnt_text_throughout(spark, tmp_path):
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9 teh\n")
    (tmp_path / "data.bin").write_bytes(b"\0 teh")
    assert _brief(spark, tmp_path) == (2, ["latin.txt:1:6: `teh` should be `the`"])
    assert _brief(spark, tmp_path, "--binary") == (2, ["data.bin:1:3: `teh` should be `the`", "latin.txt:1:6: `teh` should be `the`"])
    assert _brief(spark, tmp_path / "data.bin") == (2, ["data.bin:1:3: `teh` should be `the`"])  # named itself
    assert _run(spark, tmp_path, "--files")[1].split() == [str(tmp_path / "latin.txt")]
    assert _run(spark, tmp_path, "--write-changes")[0] == 0 and (tmp_path / "latin.txt").read_bytes() == b"caf\xe9 the\n"


def test_no_unicode(spark, tmp_path):
    (tmp_path / "a.txt").write_text("teh א teh\nplain")
    (tmp_path / "b.txt").write_text("é teh")
    assert _brief(spark, tmp_path) == (2, ["a.txt:1:1: `teh` should be `the`", "a.txt:1:8: `teh` should be `the`", "b.txt:1:4: `teh` should be `the`"])
    assert _brief(spark, tmp_path, "--no-unicode") == (2, ["a.txt:1:1: `teh` should be `the`", "a.txt:1:8: `teh` should be `the`"])  # é is cut, what follows isn't read


def test_locale(spark, tmp_path):
    (tmp_path / "a.txt").write_text("colour color Organise travelled\n")
    assert _brief(spark, tmp_path) == (0, [])
    assert _brief(spark, tmp_path, "--locale", "en-us")[1] == ["a.txt:1:14: `Organise` should be `Organize`", "a.txt:1:1: `colour` should be `color`", "a.txt:1:23: `travelled` should be `traveled`"]
    assert _brief(spark, tmp_path, "--locale", "en-gb")[1] == ["a.txt:1:8: `color` should be `colour`"]


def test_every_argument_has_its_configuration(spark, tmp_path):
    for name, text in {"a/glyphwright.toml": '[default.extend-words]\nfoo = "bar"\n', "a/sub/glyphwright.toml": '[default.extend-words]\nfoo = "foo"\nbaz = ""\n', "a/x.txt": "foo baz", "a/sub/y.txt": "foo baz", "b/z.txt": "foo baz"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    a, sub, b = tmp_path / "a", tmp_path / "a/sub", tmp_path / "b"
    assert _brief(spark, b)[1] == [] and _brief(spark, a)[1] == ["x.txt:1:1: `foo` should be `bar`", "y.txt:1:1: `foo` should be `bar`"]
    assert _brief(spark, b, sub)[1] == ["y.txt:1:5: `baz` is disallowed"]
    assert _brief(spark, sub, a)[1] == ["x.txt:1:1: `foo` should be `bar`", "y.txt:1:5: `baz` is disallowed", "y.txt:1:5: `baz` is disallowed"]
    (b / "glyphwright.toml").write_text("[default]\nnope = 1")
    assert _run(spark, a, b)[0] == 78


def test_sarif_and_stdin(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("é teh\n")
    report = json.loads(_run(spark, tmp_path, "--format", "sarif")[1])
    assert report["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "endLine": 1, "startColumn": 3, "endColumn": 6}

    class Input:
        buffer = io.BytesIO(b"teh \xff end")

    monkeypatch.setattr("sys.stdin", Input)
    assert _run(spark, "-", "--format", "brief", "--isolated") == (2, "-:1:1: `teh` should be `the`\n")
    Input.buffer = io.BytesIO(b"all teh way")
    assert _run(spark, "-", "--write-changes", "--isolated") == (0, "all the way\n")
    assert _run(spark, tmp_path / "a.txt", "-", "--files", "--isolated")[1].split() == ["-", str(tmp_path / "a.txt")]
    (tmp_path / "list").write_text("-\n")
    assert _run(spark, "--file-list", tmp_path / "list")[0] == 64
