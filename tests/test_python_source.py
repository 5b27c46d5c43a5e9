"""Python sources, parsed and linked."""

from __future__ import annotations

import pytest

from weftgraph.operators import detectors, flows
from weftgraph.operators.link import analyze_python, module_map
from weftgraph.sources.files import source_files
from weftgraph.sources.python_code import read_python

TREE = {
    "main.py": "from pkg.tools import helper as h, lost\nimport os\nimport json\n\ndef main():\n    h()\n    os.getcwd()\n",
    "pkg/__init__.py": "",
    "pkg/tools.py": "from . import other\nfrom .other import deep\n\ndef helper():\n    deep()\n\nclass K:\n    def a(self):\n        self.b()\n    def b(self):\n        pass\n",
    "pkg/other.py": "LIMIT = 3\ndef deep(x: int = 1) -> str:\n    return x\n",
    "node_modules/skip.py": "def no(): pass\n",
    "broken.py": "def good():\n    pass\n\ndef bad(:\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (top / "latin.py").write_bytes(b"x = '\xff'\n")
    return str(top)


def test_files_and_modules(spark, root):
    files = source_files(spark, root, exclude=["broken*"])
    assert sorted(r.rel_path for r in files.collect()) == ["main.py", "pkg/__init__.py", "pkg/other.py", "pkg/tools.py"]
    assert {r.key: r.path for r in module_map(files).collect()} == {"main": "main.py", "pkg": "pkg/__init__.py", "pkg.other": "pkg/other.py", "pkg.tools": "pkg/tools.py"}


def test_rows_of_one_file():
    rows = read_python("m.py", TREE["pkg/tools.py"])
    found = {(r["kind"], r["qualified_name"]) for r in rows if r["row_kind"] == "symbol"}
    assert {("Function", "m.py::helper"), ("Class", "m.py::K"), ("Method", "m.py::K::a"), ("Module", "m.py::deep")} <= found
    assert read_python("m.py", "") and read_python("m.py", "def (")


def test_linked_graph(spark, root):
    g = analyze_python(spark, root)
    name = {r.id: r.qualified_name for r in g.symbols.collect()}
    calls = {(name[r.src], name[r.dst]) for r in g.callees().collect()}
    assert {("main.py::main", "pkg/tools.py::helper"), ("pkg/tools.py::helper", "pkg/other.py::deep"), ("pkg/tools.py::K::a", "pkg/tools.py::K::b")} <= calls
    assert [r.entity for r in detectors.stale_reference(g).collect()] == ["lost"]
    assert sorted(r.entity for r in detectors.phantom_dependency(g).collect()) == ["json", "lost", "other"]
    paths = [[name[x] for x in r.path] for r in flows.all_flows(g, 8).collect()]
    assert ["pkg/tools.py::helper", "pkg/other.py::deep"] in paths
    assert "broken.py::good" in name.values()
