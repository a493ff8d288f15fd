"""File types by name: globs in order of how specific they are, the most specific match wins."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Types and what their files are called: an extension with its dot, a whole name (after = if it begins
#: with a dot), or a glob. Where several types have a glob, the last by name stands.
_NAMES = {
    kind.strip(): names.strip()
    for kind, names in (
        line.split(":", 1)
        for line in """
ada: .ads .adb
agda: .lagda .agda
aidl: .aidl
alire: alire.toml
amake: .bp .mk
asciidoc: .asciidoc .asc .adoc
asm: .S .s .asm
asp: .asp .aspx .ascx .aspx.vb .aspx.cs .ascx.vb .ascx.cs
ats: .hats .sats .dats .ats
avro: .avsc .avpr .avdl
awk: .awk
bat: .cmd .bat
bazel: BUILD WORKSPACE WORKSPACE.bzlmod WORKSPACE.bazel MODULE.bazel .bazelrc .BUILD .bzl .bazel
bitbake: .inc .conf .bbclass .bbappend .bb
boxlang: .bxs .bxm .bx
brotli: .br
buildstream: .bst
bzip2: .tbz2 .bz2
c: .cats *.[chH] *.[chH].in
cabal: .cabal
candid: .did
carp: .carp
cbor: .cbor
cert: .pem .pfx .p12 .jks .keystore .key .p7s .p7c .p7b .ca-bundle .cer .crt
ceylon: .ceylon
cfml: .cfm .cfc
clojure: .cljx .cljs .cljc .clj
cmake: CMakeLists.txt .cmake
cml: .cml
coffeescript: .coffee
config: .ini .config .conf .cfg
coq: .v
cpp: .inl .hh .cc .hh.in .cc.in *.[ch]xx *.[ch]pp *.[ChH] *.[ch]xx.in *.[ch]pp.in *.[ChH].in
creole: .creole
crystal: shard.yml .ecr .cr Projectfile
csharp: .cs
cshtml: .cshtml
css: .scss .css
csv: .csv
cuda: .cuh .cu
cython: .pxd .pxi .pyx
d: .d
dart: .dart
devicetree: .dtso .dtsi .dts
dhall: .dhall
diff: .diff .patch
dita: .ditaval .ditamap .dita
docker: *Dockerfile*
dockercompose: docker-compose.*.yml docker-compose.yml
dvc: .dvc Dvcfile
ebuild: .eclass .ebuild
edn: .edn
elisp: .el
elixir: .livemd .leex .heex .exs .eex .ex
elm: .elm
erb: .erb
erlang: .hrl .erl
fennel: .fnl
fidl: .fidl
fish: .fish
flatbuffers: .fbs
fortran: .F95 .f95 .F90 .f90 .pfo .F77 .f77 .F .f
fsharp: .fsi .fsx .fs
fut: .fut
gap: .tst .gd .gi .gap .g
gleam: .gleam
gn: .gni .gn
go: go.work go.mod .go
gprbuild: .gpr
gradle: gradlew gradlew.bat gradle.properties gradle-wrapper.* .gradle.kts .gradle
graphql: .graphqls .graphql
groovy: .gradle .groovy
gzip: .tgz .gz
h: .hpp .h
haml: .haml
hare: .ha
hbs: .hbs
hs: .hsc .c2hs .cpphs .lhs .hs
html: .ejs .html .htm
hy: .hy
idris: .lidr .idr
janet: .janet
java: .properties .jspx .jsp .java
jinja: .jinja2 .jinja .j2
jl: .jl
js: .mjs .cjs .vue .jsx .js
json: .sarif .json
jsonl: .jsonl
jupyter: .jpynb .ipynb
k: .k
kconfig: Kconfig.* Kconfig
kotlin: .kts .kt
lean: .lean
less: .less
license: COPYING COPYRIGHT EULA NOTICE PATENTS COPYING[.-]* COPYRIGHT[.-]* EULA[.-]* NOTICE[.-]* PATENTS[.-]* UNLICEN[CS]E UNLICEN[CS]E[.-]* LICEN[CS]E LICEN[CS]E[.-]* *[.-]LICEN[CS]E* licen[cs]e licen[cs]e.* lgpl[.-]* gpl[.-]* agpl[.-]* OFL-*[0-9]* MPL-*[0-9]* MIT-*[0-9]* LGPL-*[0-9]* GPL-*[0-9]* GNU-*[0-9]* GFDL-*[0-9]* CC-BY-* BSD-*[0-9]* APACHE-*[0-9]* AGPL-*[0-9]*
lilypond: .ily .ly
lisp: .scm .sc .lsp .lisp .el
llvm: .ll
lock: .lock .terraform.lock.hcl package-lock.json pnpm-lock.yaml composer.lock go.sum go.work.sum requirements.txt
log: .log
lua: .lua
lz4: .lz4
lzma: .lzma
m4: .m4 .ac
make: .mak .mk Makefile.* [Mm]akefile [Mm]akefile.am [Mm]akefile.in [Gg][Nn][Uu]makefile [Gg][Nn][Uu]makefile.am [Gg][Nn][Uu]makefile.in
mako: .mao .mako
man: *.[0-9][cEFMmpSx] *.[0-9lnpx]
matlab: .m
md: .mdx .mkdn .mkd .mdwn .mdown .md .markdown
meson: meson.build meson.options meson_options.txt
minified: .min.js .min.css .min.html
mint: .mint
mk: mkfile
ml: .ml
motoko: .mo
msbuild: .slnf .sln .targets .props .proj .vcxproj .fsproj .csproj
nim: .nims .nimble .nimf .nim
nix: .nix
objc: .m .h
objcpp: .mm .h
ocaml: .mly .mll .mli .ml
org: .org_archive .org
pascal: .inc .pp .lpr .dpr .pas
pdf: .pdf
perl: .t .pm .plx .plh .PL .pl .perl
php: .phtml .pht .php8 .php7 .php5 .php4 .php3 .php
po: .po
pod: .pod
postscript: .ps .eps
prolog: .P .prolog
protobuf: .proto
ps: .psm1 .psd1 .ps1xml .ps1 .cdxml
puppet: .rb .pp .erb .epp
purs: .purs
py: pyproject.toml .pyi .py
qmake: .prf .pri .pro
qml: .qml
r: .Rnw .Rmd .r .R
racket: .rkt
raku: .pm6 .pl6 .p6 .rakutest .rakudoc .rakumod .raku
rdoc: .rdoc
readme: *README README*
reasonml: .rei .re
red: .reds .red .r
rescript: .resi .res
robot: .robot
rst: .rst
ruby: Rakefile Gemfile config.ru =.irbrc .rake .rbw .rb .gemspec
rust: Cargo.toml .rs
sass: .scss .sass
scala: .sbt .scala
scdoc: .scdoc .scd
seed7: .sd7 .s7i
sh: .zsh .tcsh .sh .ksh .csh .env .bash .bashrc .cshrc .kshrc .tcshrc profile zshrc zshenv zprofile zlogout zlogin bashrc bash_profile bash_logout bash_login =.env =.login =.logout =.profile =.bash_login =.bash_logout =.bash_profile =.bashrc =.cshrc =.kshrc =.tcshrc =.zshenv =.zlogin =.zlogout =.zprofile =.zshrc
slim: .slime .slim .skim
smarty: .tpl
sml: .sig .sml
solidity: .sol
soy: .soy
spark: .spark
spec: .spec
sql: .psql .sql
stylus: .styl
sv: .h .svh .sv .vg .v
svelte: .svelte
svg: .svg
swift: .swift
swig: .i .def
systemd: .timer .target .swap .socket .slice .service .scope .path .mount .link .device .conf .automount
taskpaper: .taskpaper
tcl: .tcl
tex: .ins .dtx .bib .sty .cls .ltx .tex
texinfo: .texi
textile: .textile
tf: terraform.rc .tfrc .terraformrc .tfvars.json .tfvars .tf.json .tf
thrift: .thrift
toml: .toml
ts: .mts .cts .tsx .ts
twig: .twig
txt: .txt
typoscript: .typoscript
typst: .typ
usd: .usdc .usda .usd
v: .vsh .v
vala: .vala
vb: .vb
vcl: .vcl
verilog: .svh .sv .vh .v
vhdl: .vhdl .vhd
vimscript: vimrc gvimrc _vimrc _gvimrc =.vimrc =.gvimrc .vim
webidl: .widl .webidl .idl
wgsl: .wgsl
wiki: .wiki .mediawiki
xml: .xhtml .sch .rng .xjb .xsd .xslt .xsl .dtd .xml.dist .xml
xz: .txz .xz
yacc: .y
yaml: .yml .yaml
yang: .yang
z: .Z
zig: .zig
zsh: .zsh zshrc zshenv zprofile zlogout zlogin =.zshrc =.zshenv =.zprofile =.zlogout =.zlogin
zstd: .zstd .zst
""".strip().splitlines()
    )
}


def _glob(name: str) -> str:
    return name[1:] if name.startswith("=") else f"*{name}" if name.startswith(".") else name


#: Types and their globs; a project's own are added to these.
DEFAULT_TYPES: dict[str, list[str]] = {kind: [_glob(n) for n in names.split()] for kind, names in _NAMES.items()}


def sort_key(glob: str) -> list[tuple[int, str]]:
    """Parts between dots from the last to the first; wild ones before partly wild, those before others."""
    return [(0 if s == "*" else 1 if "*" in s else 2, s) for s in reversed(glob.split("."))]


def glob_regex(glob: str) -> str:
    """The glob as an expression for a whole name; ``*`` and ``?`` don't match a slash."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" if body[0] in "!^" else "") + body.lstrip("!^").replace("\\", "\\\\") + "]", end + 1
            continue
        if c == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_regex(p) for p in glob[i + 1 : end].split(",")) + ")", end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return out


def ranked(types: Mapping[str, Sequence[str]], own: Mapping[str, Sequence[str]] | None = None) -> list[tuple[str, str, int]]:
    """(type, glob, rank): the higher rank wins. Equal globs: a project's own, then the later name."""
    rows = [(sort_key(g), weight, name, g) for weight, group in enumerate((types, own or {})) for name, globs in group.items() for g in globs]
    return [(name, glob, i) for i, (_, _, name, glob) in enumerate(sorted(rows))]


class Types:
    """Looks names up; what is asked often is remembered."""

    def __init__(self, order: Sequence[tuple[str, str, int]]):
        self.exact: dict[str, tuple[int, str]] = {}
        self.suffix: dict[str, tuple[int, str]] = {}
        self.wild: list[tuple[int, str, re.Pattern]] = []
        for kind, glob, rank in order:
            if not set(glob) & set("*?[{"):
                self.exact[glob] = max(self.exact.get(glob, (-1, "")), (rank, kind))
            elif glob.startswith("*.") and not set(glob[2:]) & set("*?[{"):
                self.suffix[glob[1:]] = max(self.suffix.get(glob[1:], (-1, "")), (rank, kind))
            else:
                self.wild.append((rank, kind, re.compile(f"(?:{glob_regex(glob)})\\Z")))
        self.wild.sort(key=lambda w: -w[0])
        self.seen: dict[str, str | None] = {}

    def match(self, name: str) -> str | None:
        best = self.exact.get(name, (-1, None))
        for i, c in enumerate(name):
            if c == ".":
                best = max(best, self.suffix.get(name[i:], best), key=lambda x: x[0])
        for rank, kind, pattern in self.wild:
            if rank <= best[0]:
                break
            if pattern.match(name):
                best = (rank, kind)
        return best[1]

    def of(self, name: str) -> str | None:
        if name not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            shorter, found = name, self.match(name)
            while found is None and shorter.endswith(".in") and len(shorter) > 3:
                shorter = shorter[:-3]
                found = self.match(shorter)
            self.seen[name] = found
        return self.seen[name]


def file_type(path: Column, types: Mapping[str, Sequence[str]] = DEFAULT_TYPES, own: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The type of a path's file name; while nothing matches and the name ends in ``.in``, that is
    taken off. Null without a match."""
    ship(SparkSession.active())
    order = ranked(types, own)
    held: list[Types] = []

    @F.arrow_udf("string")
    def found(names: pa.Array) -> pa.Array:
        if not held:
            held.append(Types(order))
        coded = names.dictionary_encode()
        kinds = pa.array([None if n is None else held[0].of(n) for n in coded.dictionary.to_pylist()], pa.string())
        return kinds.take(coded.indices)

    return found(F.element_at(F.split(path, "/"), -1))


def type_list(globs: DataFrame) -> DataFrame:
    """(type, globs): a type's globs in order, a glob belonging to the last type that has it."""
    last = globs.groupBy("glob").agg(F.max_by("type", "rank").alias("type"))
    return last.groupBy("type").agg(F.array_join(F.sort_array(F.collect_list("glob")), ", ").alias("globs"))
