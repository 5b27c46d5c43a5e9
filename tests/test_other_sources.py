"""JavaScript, TypeScript and Rust sources, and Python ones with errors: rows of one file, and trees linked across files."""

from __future__ import annotations

import pytest

from weftgraph.operators.link import analyze_source, module_map
from weftgraph.sources.files import source_files
from weftgraph.sources.javascript_code import read_script
from weftgraph.sources.python_code import read_python
from weftgraph.sources.rust_code import read_rust

TREE = {
    "web/src/app.js": "import {area as size, Shape} from './geo/shapes';\nimport start from '../lib';\nimport * as all from './geo/shapes';\nconst util = require('./util');\nconst {trim} = require('./util');\nexport function run(x) {\n  start();\n  return size(trim(x));\n}\n",
    "web/src/geo/shapes.ts": "export interface Box { w: number }\nexport class Shape {}\nexport const area = (b: Box, k: number = 1): number => half(b);\nfunction half(b: Box) { return b.w }\n",
    "web/src/util.js": "function trim(s) { return s }\nexport { trim };\n",
    "web/lib/index.js": "export default function start() {}\nexport { area } from '../src/geo/shapes';\nexport * from '../src/util';\nimport gone from '../../../outside';\n",
    "core/src/lib.rs": "pub mod util;\nmod deep;\nuse crate::util::twice;\nuse crate::deep::{self, Thing};\npub fn top() -> u8 { twice(deep::inner()) }\n",
    "core/src/util.rs": "use super::deep::inner as first;\nuse self::super::deep::Thing;\npub fn twice(x: u8) -> u8 { x + inner() }\nfn inner() -> u8 { 1 }\n",
    "core/src/deep/mod.rs": "pub struct Thing;\nimpl Thing { pub fn make(&self) { self.part() } fn part(&self) {} }\npub fn inner() -> u8 { 2 }\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("mixed")
    for name, text in TREE.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(top)


def symbols(rows):
    return {(r["kind"], r["name"]): r for r in rows if r["row_kind"] == "symbol"}


def uses(rows, tag="call"):
    return [r["arg"] for r in rows if r["row_kind"] == "ref" and r["tag"] == tag]


def test_script_declarations():
    text = "export default async function main(x, {y} = {}) { go(`a ${inner(1)} }`) }\nconst f = (p) => main(p), g = q => f(q), h = function* () { yield f() }, n = 5;\nexport class A extends mixin(B) {\n  #p = f(1)\n  static async load(x) { return this.run(x) }\n  get size() { return /re\"g/.test('x') ? new Foo(g()) : 1 }\n  set size(v) {}\n  run() { a.b.c() }\n}\nexport { f as other };\n"
    rows = read_script("m.js", "javascript", text)
    found = symbols(rows)
    assert {k: r["visibility"] for k, r in found.items() if k[1] != "<module>"} == {
        ("Function", "main"): "Public", ("Function", "f"): "Public", ("Function", "g"): "Private", ("Function", "h"): "Private", ("Class", "A"): "Public",
        ("Method", "load"): "Public", ("Method", "get_size"): "Public", ("Method", "set_size"): "Public", ("Method", "run"): "Public",
    }
    assert found["Function", "main"]["signature"] == "(x, {y} = {})" and found["Method", "run"]["qualified_name"] == "m.js::A::run"
    assert uses(rows) == ["go", "inner", "main", "f", "f", "mixin", "f", "this.run", "g", "a.b.c"]


def test_script_imports():
    text = "import d, {a, b as c} from './m';\nimport * as ns from 'n';\nimport 'side';\nconst fs = require('fs'), {join: j, sep} = require('path');\nconst dyn = require(name);\nexport { q as r } from './o';\nexport * from './all';\n"
    rows = read_script("m.js", "javascript", text)
    got = {n: (k, r["visibility"], tuple(r["annotations"][1:])) for (k, n), r in symbols(rows).items() if r["annotations"][:1] == ["import"]}
    assert got == {
        "d": ("Module", "Private", ("from:./m",)), "a": ("Module", "Private", ("from:./m",)), "c": ("Module", "Private", ("from:./m", "original_name:b")), "ns": ("Module", "Private", ("from:n",)),
        "fs": ("Module", "Private", ("from:fs",)), "j": ("Variable", "Private", ("from:path", "original_name:join")), "sep": ("Variable", "Private", ("from:path",)),
        "r": ("Module", "Public", ("from:./o", "original_name:q")), "*:./all": ("Module", "Public", ("from:./all",)),
    }
    assert uses(rows) == ["require"] and len(uses(rows, "import")) == len(got)
    assert symbols(rows)["Module", "a"]["qualified_name"] == "m.js::import::a"


def test_typescript():
    text = "export interface Shape<T> { area(): number }\ntype Id = string | number;\nexport const enum Dir { Up }\ndeclare function ext(a: string): void;\nexport abstract class Base<T> implements Shape<T> {\n  private readonly m: Map<string, number> = fill();\n  constructor(private a: number, b?: string) { init(a) }\n  abstract area(): number;\n  go<T>(v: T, w: {a: number} = {a: 1}): Promise<{ ok: boolean }> { return this.done<T>(v) }\n}\nimport type { X } from './x';\n"
    rows = read_script("m.ts", "typescript", text)
    found = symbols(rows)
    assert {(k, n): (r["visibility"], r["line"], r["column"]) for (k, n), r in found.items() if k in ("Interface", "Enum")} == {("Interface", "Shape"): ("Public", 1, 1), ("Interface", "Id"): ("Private", 2, 1), ("Enum", "Dir"): ("Public", 3, 1)}
    assert found["Interface", "Id"]["annotations"] == ["type_alias"] and found["Function", "ext"]["annotations"] == ["declare"] and ("Method", "area") not in found
    assert found["Method", "go"]["signature"] == "(v, w = {a: 1})" and found["Method", "constructor"]["signature"] == "(private a, b)" and found["Class", "Base"]["visibility"] == "Public"
    assert uses(rows) == ["fill", "init", "this.done"] and ("Module", "X") in found
    assert not any(k == "Interface" for k, _ in symbols(read_script("m.js", "javascript", text)))


def test_rust_rows():
    text = "/* a /* nested */ one */\nuse std::collections::{HashMap, hash_map::Entry as E, *};\npub(crate) use crate::x::{self, y};\n#[derive(Debug)]\npub struct P<T> { x: HashMap<String, T> }\nenum V { A(u8), B }\npub trait Area { fn area(&self) -> f64; }\npub const MAX: usize = 1;\nstatic mut S: char = 'x';\nimpl<T> Area for P<T> {\n    fn area(&self) -> f64 { self.help(1); x::run::<u8>(2); println!(\"{}\", lost()); a.b.c() }\n    pub(super) async fn help<'a>(&'a self, s: &'a str) -> Result<(), ()> where T: Clone { fn nested() {} Ok(()) }\n}\nmod inner { pub fn deep() { super::go() } }\n"
    rows = read_rust("m.rs", "rust", text)
    found = symbols(rows)
    got = {(k, n): r["visibility"] for (k, n), r in found.items() if not r["annotations"] and n != "<module>"}
    assert got == {
        ("Struct", "P"): "Public", ("Enum", "V"): "Private", ("Trait", "Area"): "Public", ("Constant", "MAX"): "Public", ("Constant", "S"): "Private", ("Method", "area"): "Private",
        ("Method", "help"): "Protected", ("Function", "nested"): "Private", ("Function", "deep"): "Public",
    }
    assert {n: (r["visibility"], r["annotations"]) for (k, n), r in found.items() if r["annotations"]} == {
        "HashMap": ("Private", ["import", "from:std::collections"]), "E": ("Private", ["import", "from:std::collections::hash_map"]), "x": ("Crate", ["import", "from:crate::x"]), "y": ("Crate", ["import", "from:crate::x"]),
    }
    assert all(r["kind"] == "Variable" and r["resolution"] == "Unresolved" for r in found.values() if r["annotations"])
    assert found["Method", "help"]["signature"] == "(&'a self, s: &'a str) -> Result<(), ()>" and found["Method", "area"]["qualified_name"] == "m.rs::P::area"
    assert uses(rows) == ["self.help", "run", "a.b.c", "Ok", "go"] and "*:std::collections" in uses(rows, "import")
    assert {"HashMap", "String", "x", "Clone"} <= set(uses(rows, "attribute_access")) and not {"u8", "A", "B"} & set(uses(rows, "attribute_access"))


@pytest.mark.parametrize("text", ["", "}}}", "class {", "function (", "fn (", "`${`${", "impl", "use {a, {b", "import {", "'", "/* open", "x" * 5000, "(" * 3000, "a(" * 3000, "class A { b() { " * 600])
def test_broken_text_gives_what_can_be_read(text):
    assert read_script("m.ts", "typescript", text)[0]["row_kind"] == read_rust("m.rs", "rust", text)[0]["row_kind"] == read_python("m.py", text)[0]["row_kind"] == "scope"


def test_python_goes_on_behind_errors():
    rows = read_python("m.py", "import os\ndef broken(:\n    pass\n@mark\ndef good():\n    os.sep\nclass K:\n    def a(self):\n        x = = 1\n        self.b()\n    def b(self): pass\ndef last(): good()\n")
    found = symbols(rows)
    assert {("Function", "good"), ("Class", "K"), ("Method", "a"), ("Method", "b"), ("Function", "last")} <= set(found) and found["Function", "last"]["line"] == 12
    assert uses(rows) == ["self.b", "good"] and uses(rows, "attribute_access") == ["os"]


def test_module_keys(spark, root):
    keys = {r.key: r.path for r in module_map(source_files(spark, root)).collect()}
    assert keys == {
        "src/app": "web/src/app.js", "src/geo/shapes": "web/src/geo/shapes.ts", "src/util": "web/src/util.js", "lib/index": "web/lib/index.js",
        "crate": "core/src/lib.rs", "crate::util": "core/src/util.rs", "crate::deep": "core/src/deep/mod.rs",
    }
    rows = [("a/b/x.rs", "rust"), ("a/c/mod.rs", "rust"), ("x.js", "javascript")]
    keys = {r.key: r.path for r in module_map(spark.createDataFrame(rows, "rel_path string, language string")).collect()}
    assert keys == {"crate::b::x": "a/b/x.rs", "crate::c": "a/c/mod.rs", "x": "x.js"}


def test_linked_trees(spark, root):
    g = analyze_source(spark, root)
    rows = {r.id: r for r in g.symbols.collect()}
    calls = {(rows[r.src].qualified_name, rows[r.dst].qualified_name) for r in g.callees().collect()}
    js, rs = "web/src/", "core/src/"
    assert {
        (js + "app.js::run", "web/lib/index.js::start"), (js + "app.js::run", js + "geo/shapes.ts::area"), (js + "app.js::run", js + "util.js::trim"), (js + "geo/shapes.ts::area", js + "geo/shapes.ts::half"),
        (rs + "lib.rs::top", rs + "util.rs::twice"), (rs + "util.rs::twice", rs + "util.rs::inner"), (rs + "deep/mod.rs::Thing::make", rs + "deep/mod.rs::Thing::part"),
    } <= calls
    state = {(r.file, r.name): (r.resolution, r.resolution_info) for r in rows.values() if "import" in r.annotations}
    assert state["core/src/util.rs", "Thing"][0] == "Resolved"
    assert state["core/src/lib.rs", "deep"] == ("Partial", "module resolved, symbol not found")  # `self` in a list is looked up by name in the module itself
    assert state["core/src/util.rs", "first"] == ("Partial", "module resolved, symbol not found")  # under an alias Rust imports are looked up by the alias
    assert state["web/lib/index.js", "*:../src/util"][1] == "star import - module resolved" and state["web/lib/index.js", "gone"] == ("Partial", "import")
    assert state["web/src/app.js", "all"] == ("Partial", "module resolved, symbol not found") and state["web/lib/index.js", "area"][0] == "Resolved"
    only = analyze_source(spark, root, languages=["rust"])
    assert {r.file.rsplit(".", 1)[1] for r in only.symbols.select("file").distinct().collect()} == {"rs"}


def test_calls_through_instance_attributes(spark, tmp_path):
    (tmp_path / "m.py").write_text("class K:\n    def __init__(self, db: DB):\n        if db:\n            self.db: DB = db\n    def go(self):\n        self.db.run()\n        self.other.run()\nclass DB:\n    def run(self): pass\nclass Z:\n    def run(self): pass\n")
    g = analyze_source(spark, str(tmp_path))
    name = {r.id: r.qualified_name for r in g.symbols.collect()}
    assert {(name[r.src], name[r.dst]) for r in g.callees().collect()} == {("m.py::K::go", "m.py::DB::run")}
    kept = g.refs.filter("resolution_info LIKE 'instance_attr_type:%'").collect()
    assert [(r.dst, r.resolution_info) for r in kept] == [(None, "instance_attr_type:K.db=DB")]
