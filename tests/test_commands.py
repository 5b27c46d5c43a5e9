"""Settings, ignore files, whole analyses, sinks and the command line, on small trees of our own."""

from __future__ import annotations

import io
import json

import pytest
import yaml

from weftgraph.__main__ import main
from weftgraph.plans import analysis, config
from weftgraph.plans.config import AnalysisError
from weftgraph.sinks import text
from weftgraph.sources import ignore
from weftgraph.sources.files import detected_languages, source_files

TREE = {
    "main.py": "from _tools import helper\nimport os\n\ndef main():\n    helper()\n",
    "_tools.py": "from pkg import deep\n\ndef helper():\n    deep()\n\ndef _unused(x: int) -> str:\n    return 'x'\n",
    "pkg/__init__.py": "def deep():\n    pass\n",
    ".hidden/seen.py": "def seen(): pass\n",
    "web/app.js": "export function run() { step() }\nfunction step() {}\n",
    "logs/a.py": "def a(): pass\n",
    "logs/keep.py": "def keep(): pass\n",
    "gen/out.py": "def out(): pass\n",
    "deep/x.tmp.py": "def x(): pass\n",
    ".gitignore": "# comment\nlogs/*\n!logs/keep.py\n/gen/\n*.tmp.py\n",
    "pkg/.gitignore": "local.py\n",
    "pkg/local.py": "def local(): pass\n",
    "pkg/sub/local.py": "def local(): pass\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("project")
    for name, content in TREE.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    return top


@pytest.fixture(scope="module")
def manifest(spark, root):
    return analysis.analyze(spark, str(root))


def written(writer, *args):
    out = io.StringIO()
    writer(*args, out)
    return out.getvalue()


def test_hidden_and_ignored_files(spark, root):
    seen = {r.rel_path: r.n_bytes for r in source_files(spark, str(root)).collect()}
    assert set(seen) == {"main.py", "_tools.py", "pkg/__init__.py", ".hidden/seen.py", "web/app.js", "logs/keep.py"}
    assert all(seen[k] == len(TREE[k]) for k in seen)  # also of names that Spark's readers pass over
    every = {r.rel_path for r in source_files(spark, str(root), ignores=False).collect()}
    assert every == {k for k in TREE if k.endswith((".py", ".js"))}
    assert detected_languages(spark, str(root)) == ["javascript", "python"]
    one = source_files(spark, str(root / "main.py")).collect()
    assert [(r.rel_path, r.language) for r in one] == [("main.py", "python")]


@pytest.mark.parametrize(
    ("rule", "path", "hit"),
    [
        ("a", "x/a", True), ("/a", "x/a", False), ("a/b", "x/a/b", False), ("a/b", "a/b/c.py", True), ("a/", "a", False), ("a/", "a/x", True), ("**/a", "x/y/a", True), ("a/**", "a/x/y", True), ("a/**/b", "a/b", True),
        ("*.py", "x/y.py", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[ab].py", "b.py", True), ("[!ab].py", "b.py", False), ("[", "[", True), ("\\#x", "#x", True), ("x.y", "xzy", False), ("# c", "# c", False),
    ],
)
def test_ignore_rules(spark, rule, path, hit):
    from pyspark.sql import functions as F

    assert spark.range(1).select(ignore.ignored(F.lit(path), ignore.rules_of(rule))).first()[0] is hit


def test_config(tmp_path, caplog):
    assert config.load_config(tmp_path).languages == []
    with pytest.raises(AnalysisError):
        config.load_config(tmp_path, tmp_path / "none.yaml")
    first = config.init(tmp_path, ["python"])
    assert config.init(tmp_path, ["rust"]) == first and config.load_config(tmp_path).languages == ["python"]
    for content in ("", "# only a comment\n", "- a list\n", "languages: python\n", "{ broken"):
        (tmp_path / "c.yaml").write_text(content)
        assert config.load_config(tmp_path, tmp_path / "c.yaml").languages == []
    assert yaml.safe_load(config.written_config([])) == {"languages": [], "exclude": []}
    assert config.language_names(["JS", "python", "py"]) == ["javascript", "python"] and config.adapters(["typescript"]) == ["typescript", "javascript"]
    with pytest.raises(AnalysisError):
        config.language_names(["cobol"])


def test_chosen_languages_and_excludes(spark, root):
    files = {r.rel_path for r in analysis.graph_of(spark, str(root), config.Config(["python"], ["_tools.py"]))[1].collect()}
    assert "web/app.js" not in files and "_tools.py" not in files
    _, files, active = analysis.graph_of(spark, str(root), config.Config(["python"]), ["typescript"])
    assert active == ["typescript"] and {r.rel_path for r in files.collect()} == {"web/app.js"}


def test_manifest_round_trips(spark, root, manifest, tmp_path):
    assert manifest.metadata["file_count"] == 6 and manifest.metadata["languages"] == ["javascript", "python"] and manifest.metadata["project"] == root.name
    found = json.loads(written(text.write_manifest, manifest, "json"))
    assert list(found) == ["metadata", "summary", *analysis.SECTIONS] and yaml.safe_load(written(text.write_manifest, manifest, "yaml")) == found
    assert len(found["entities"]) == found["metadata"]["entity_count"] and len(found["diagnostics"]) == found["metadata"]["diagnostic_count"] > 0
    assert found["boundaries"] == found["type_flows"] == found["summary"]["exit_points"] == []
    deep = next(e for e in found["entities"] if e["id"].endswith("deep"))
    assert deep["called_by"] and deep["kind"] == "fn" and deep["vis"] == "pub"
    assert any(f["entry"] == "main.py::main" and len(f["steps"]) == 2 for f in found["flows"])
    for name in ("m.json", "m.yaml", "m.txt"):
        (tmp_path / name).write_text(written(text.write_manifest, manifest, "yaml" if name == "m.yaml" else "json"))
        again = analysis.load_manifest(spark, str(tmp_path / name))
        assert json.loads(written(text.write_manifest, again, "json")) == found
    for bad in ("", "[1, 2]", "{ nothing", "a: 1"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(AnalysisError):
            analysis.load_manifest(spark, str(tmp_path / "bad.json"))
    with pytest.raises(AnalysisError):
        analysis.load_manifest(spark, str(tmp_path / "none.json"))
    text.write_tables(manifest, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/entities")).count() == len(found["entities"]) and spark.read.parquet(str(tmp_path / "tables/summary")).first().architecture == found["summary"]["architecture"]


def test_sarif(manifest):
    run = json.loads(written(text.write_manifest, manifest, "sarif"))
    assert run["version"] == "2.1.0" and len(run["runs"]) == 1
    results, rules = run["runs"][0]["results"], run["runs"][0]["tool"]["driver"]["rules"]
    assert len(results) == manifest.metadata["diagnostic_count"] and [r["id"] for r in rules] == list(dict.fromkeys(r["ruleId"] for r in results))
    assert all("_" not in r["shortDescription"]["text"] for r in rules)
    d = {"pattern": "p", "severity": "odd", "message": "m", "loc": "C:\\a.py:12", "evidence": [{"observation": "no"}, {"observation": "yes", "location": "b.py"}]}
    got = text.sarif_result(d)
    assert got["level"] == "warning" and got["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "C:\\a.py"}, "region": {"startLine": 12}}
    assert got["relatedLocations"] == [{"id": 2, "physicalLocation": {"artifactLocation": {"uri": "b.py"}}, "message": {"text": "yes"}}]
    assert "relatedLocations" not in text.sarif_result(d | {"evidence": []})


def test_summary_and_findings(spark, manifest):
    page = written(text.write_manifest, manifest, "summary")
    assert manifest.metadata["project"] in page and "== Modules ==" in page and len(page) <= 10_000
    found = manifest.sections["diagnostics"]
    assert json.loads(written(text.write_findings, found, "json")) == yaml.safe_load(written(text.write_findings, found, "yaml"))
    assert written(text.write_findings, found, "summary").startswith(f"{found.count()} finding(s)")
    none = analysis.Manifest.empty(spark, "nothing")
    assert written(text.write_findings, none.sections["diagnostics"], "yaml") == "[]\n" and json.loads(written(text.write_findings, none.sections["diagnostics"], "json")) == []
    for form in text.FORMATS:
        assert written(text.write_manifest, none, form)
    assert json.loads(written(text.write_manifest, none, "json"))["entities"] == []
    with pytest.raises(AnalysisError):
        written(text.write_manifest, none, "xml")


def test_size_guard():
    text.checked_size(10**9, 1023, "json")
    text.checked_size(20_479, 1024, "json")
    text.checked_size(10**9, 1024, "summary")
    text.checked_size(15 * 2048, 2048, "json")
    for form, ratio in (("yaml", 10), ("json", 15), ("sarif", 20), ("other", 10)):
        with pytest.raises(AnalysisError):
            text.checked_size(ratio * 4096 + 1, 4096, form)


def test_trace(spark, root):
    forward = [[s.entity for s in f.steps] for f in analysis.trace(spark, str(root), "main").collect()]
    assert forward == [["_tools.py::helper", "pkg/__init__.py::deep"]]
    back = analysis.trace(spark, str(root), "deep", "backward").collect()
    assert [[s.entity for s in f.steps] for f in back] == [["_tools.py::helper", "main.py::main"]] and back[0].entry == "pkg/__init__.py::deep"
    assert analysis.trace(spark, str(root), "_tools.py::helper", "both").count() == 2
    assert [len(f.steps) for f in analysis.trace(spark, str(root), "main", depth=1).collect()] == [1]
    with pytest.raises(AnalysisError):
        analysis.trace(spark, str(root), "nobody")
    with pytest.raises(AnalysisError):
        analysis.trace(spark, str(root), "main", "sideways")
    entries = analysis.trace(spark, str(root), "main")
    for form in text.FORMATS:
        assert "deep" in written(text.write_flows, entries, form)
    assert json.loads(written(text.write_flows, entries, "sarif"))["runs"][0]["results"][0]["ruleId"] == "flow-trace"


def test_difference(spark, manifest):
    d = json.loads(written(text.write_manifest, manifest, "json"))
    same = analysis.compare(manifest, manifest)
    assert same.summary == ["no changes"] and same.exit_code == 0
    d["entities"][0]["sig"], gone = "(other)", d["entities"].pop()
    d["diagnostics"].append({**d["diagnostics"][0], "entity": "new", "severity": "critical"})
    new = analysis.from_dict(spark, d)
    found = analysis.compare(manifest, new)
    assert found.has_regressions and found.exit_code == 2
    plain = json.loads(written(text.write_difference, found, "json"))
    assert plain["entities_removed"] == [gone["id"]] and plain["entities_changed"][0]["changes"][0]["new"] == "(other)" and plain["diagnostics_new"][0]["entity"] == "new"
    assert yaml.safe_load(written(text.write_difference, found, "yaml")) == plain
    assert f"  - {gone['id']}\n" in written(text.write_difference, found, "summary")
    only = analysis.compare(manifest, new, ["entities"])
    assert only.exit_code == 0 and set(only.rows) == {"entities_added", "entities_removed", "entities_changed"}
    with pytest.raises(AnalysisError):
        analysis.compare(manifest, new, ["flows"])
    with pytest.raises(AnalysisError):
        written(text.write_difference, found, "sarif")


def test_command_line(spark, root, tmp_path, capsys):
    out = tmp_path / "m.json"
    assert main(["analyze", str(root), "-f", "json", "-o", str(out)], spark) == 0
    assert capsys.readouterr().out == "" and json.loads(out.read_text())["metadata"]["file_count"] == 6
    assert main(["diagnose", str(root), "-f", "json", "--checks", "data_dead_end", "--confidence", "high"], spark) == 2
    found = json.loads(capsys.readouterr().out)
    assert {d["pattern"] for d in found} == {"data_dead_end"} and all(d["confidence"] == "high" for d in found)
    assert main(["diagnose", str(root), "--checks", "layer_violation"], spark) == 0
    assert main(["diagnose", str(root), "--checks", "nonsense"], spark) == 1
    assert main(["trace", str(root), "-s", "main", "-f", "summary"], spark) == 0 and "1 flow(s)" in capsys.readouterr().out
    assert main(["diff", str(out), str(out), "-f", "summary"], spark) == 0 and "no changes" in capsys.readouterr().out
    assert main(["diff", str(out), str(tmp_path / "none")], spark) == 1 and main(["watch", str(root)], spark) == 1 and main(["analyze", str(root / "none")], spark) == 1
    (tmp_path / "new").mkdir()
    (tmp_path / "new/a.rs").write_text("fn main() {}\n")
    capsys.readouterr()
    assert main(["init", str(tmp_path / "new")], spark) == 0
    assert yaml.safe_load(capsys.readouterr().out) == {"languages": ["rust"], "exclude": []} and (tmp_path / "new/.weftgraph/config.yaml").exists()
    with pytest.raises(SystemExit):
        main(["analyze", "-v", "-q"], spark)
