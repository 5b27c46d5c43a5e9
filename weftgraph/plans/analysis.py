"""Analyses of a source tree: manifests, findings, traces and differences between manifests.

A manifest's sections stay DataFrames until a sink writes them, row by row for text.
"""

from __future__ import annotations

import datetime
import json
import logging
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schemas
from weftgraph.operators import detectors, diff, flows, summary
from weftgraph.operators.graph import CodeGraph
from weftgraph.operators.link import analyze_files
from weftgraph.plans.config import AnalysisError, Config, adapters, language_names, load_yaml
from weftgraph.runtime import cut
from weftgraph.sources.files import source_files

log = logging.getLogger("weftgraph")
VERSION = "0.2.0"
#: Sections in the order of a manifest, with the schemas of their rows.
SECTIONS = {
    "diagnostics": f"id string, pattern string, severity string, confidence string, entity string, message string, evidence {schemas.EVIDENCE}, suggestion string, loc string",
    "entities": "id string, kind string, vis string, sig string, loc string, calls array<string>, called_by array<string>, annotations array<string>",
    "flows": f"id string, description string, entry string, exit string, steps array<{schemas.FLOW_STEP}>, issues array<string>",
    "boundaries": "id string, type string, from string, to string, crossing_points array<struct<fn:string,data_in:string,data_out:string>>, issues array<string>",
    "dependency_graph": "from string, to string, weight bigint, direction string, issues array<string>",
    "type_flows": "type string, created_at array<string>, transformed_to array<struct<target_type:string,via:string>>, consumed_by array<string>, lifetime string",
}
METADATA = "project string, analyzed_at string, tool_version string, languages array<string>, file_count bigint, entity_count bigint, flow_count bigint, diagnostic_count bigint, incremental boolean, files_changed bigint"
SUMMARY = (
    "architecture string, modules array<struct<name:string,entity_count:bigint,role:string>>, entry_points array<string>, exit_points array<string>, key_flows array<struct<name:string,path_summary:string>>, "
    "diagnostic_summary struct<critical:bigint,warning:bigint,info:bigint,top_issues:array<string>>"
)
DIRECTIONS = ("forward", "backward", "both")


@dataclass(frozen=True)
class Manifest:
    """metadata and summary are plain values; sections are DataFrames by name, in SECTIONS' order."""

    metadata: dict
    summary: dict
    sections: dict[str, DataFrame]
    n_bytes: int = 0
    has_critical: bool = False  # among all findings, also those that filters leave out

    @classmethod
    def empty(cls, spark: SparkSession, project: str = "") -> Manifest:
        """A manifest of nothing."""
        counts = {"critical": 0, "warning": 0, "info": 0, "top_issues": []}
        about = {"architecture": summary.architecture([], 0, 0), "modules": [], "entry_points": [], "exit_points": [], "key_flows": [], "diagnostic_summary": counts}
        return cls(_metadata(project, [], 0, 0, 0, 0), about, {k: spark.createDataFrame([], s) for k, s in SECTIONS.items()})


def _metadata(project: str, languages: list[str], files: int, entities: int, n_flows: int, findings: int) -> dict:
    now = datetime.datetime.now(datetime.UTC).isoformat()
    return {
        "project": project, "analyzed_at": now, "tool_version": VERSION, "languages": languages, "file_count": files, "entity_count": entities, "flow_count": n_flows,
        "diagnostic_count": findings, "incremental": False, "files_changed": 0,
    }


def chosen_languages(asked: list[str] | None, config: Config) -> list[str]:
    """What the caller asks for, else what the settings name; none means all that are found."""
    return language_names(asked) if asked else language_names(config.languages)


def graph_of(spark: SparkSession, root: str, config: Config | None = None, languages: list[str] | None = None) -> tuple[CodeGraph, DataFrame, list[str]]:
    """(linked graph, files, active languages) of the sources below root, or of one file."""
    config = config or Config()
    wanted = chosen_languages(languages, config)
    files = cut(source_files(spark, root, config.exclude, adapters(wanted) if wanted else None))
    active = wanted or [r[0] for r in files.select("language").distinct().orderBy("language").collect()]
    g = analyze_files(files)
    return CodeGraph(cut(g.symbols), cut(g.refs), g.scopes, g.boundaries), files, active


def _names(checks: list[str] | None) -> list[str]:
    try:
        return detectors.check_names(checks)
    except ValueError as e:
        raise AnalysisError(str(e)) from e


def findings(graph: CodeGraph, checks: list[str] | None = None, severity: str | None = None, confidence: str | None = None) -> DataFrame:
    """Numbered findings, filtered by pattern names and by least severity and confidence (after they have their numbers)."""
    return detectors.at_least(detectors.diagnostics(graph), severity, confidence, _names(checks))


def analyze(spark: SparkSession, root: str, config: Config | None = None, languages: list[str] | None = None, checks: list[str] | None = None, severity: str | None = None, confidence: str | None = None) -> Manifest:
    """The manifest of the sources below root."""
    _names(checks)  # wrong names are refused before any work
    graph, files, active = graph_of(spark, root, config, languages)
    every = cut(findings(graph))
    found = summary.manifest_entries(detectors.at_least(every, severity, confidence, _names(checks)))
    entity_rows = cut(summary.entities(graph))
    flow_rows = cut(flows.deduplicated(flows.flow_entries(graph, flows.all_flows(graph))))
    modules = summary.modules(graph)
    size = files.agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).first()
    counts = summary.severity_counts(found).first()
    top = [r["message"] for r in summary.top_issues(found).collect()]
    n_entities, n_flows, n_found = entity_rows.count(), flow_rows.count(), found.count()
    about = {
        "architecture": summary.architecture(active, size["n"], n_entities),
        "modules": [r.asDict() for r in modules.collect()],  # a row for each file, as the manifest itself lists them
        "entry_points": [r["id"] for r in summary.program_entries(entity_rows).orderBy("id").collect()],
        "exit_points": [], "key_flows": [],
        "diagnostic_summary": {"critical": counts["critical"], "warning": counts["warning"], "info": counts["info"], "top_issues": top},
    }
    made = {"diagnostics": found.orderBy("id"), "entities": entity_rows.orderBy("ord", "file", "id"), "flows": flow_rows.orderBy(F.length("id"), "id"), "dependency_graph": summary.dependency_graph(graph)}
    sections = {k: made[k].select(*(F.col(f.name).cast(f.dataType) for f in _schema(spark, s))) if k in made else spark.createDataFrame([], s) for k, s in SECTIONS.items()}
    project = Path(root.split(":", 1)[-1].rstrip("/")).name or "unknown"
    return Manifest(_metadata(project, active, size["n"], n_entities, n_flows, n_found), about, sections, int(size["b"] or 0), not every.filter("severity = 'critical'").isEmpty())


def _schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def trace(spark: SparkSession, root: str, symbol: str, direction: str = "forward", depth: int = flows.TRACE_DEPTH, config: Config | None = None, languages: list[str] | None = None) -> DataFrame:
    """Flow entries of one symbol: forward over callees, backward over callers, or both (then without repeats). Steps stop at depth."""
    if direction not in DIRECTIONS:
        raise AnalysisError(f"unknown direction {direction!r}; known: {', '.join(DIRECTIONS)}")
    graph, _, _ = graph_of(spark, root, config, languages)
    return trace_graph(graph, symbol, direction, depth)


def trace_graph(graph: CodeGraph, symbol: str, direction: str = "forward", depth: int = flows.TRACE_DEPTH) -> DataFrame:
    entity_rows = summary.entities(graph).select("id", "symbol_id")
    try:
        wanted = flows.find_symbol(entity_rows, symbol)
    except LookupError as e:
        raise AnalysisError(str(e)) from e
    start = cut(entity_rows.filter(F.col("id") == wanted).select(F.col("symbol_id").alias("id")).limit(1))
    ways = [w(graph, start, depth) for w, ok in ((flows.trace_from, direction != "backward"), (flows.trace_to, direction != "forward")) if ok]
    entries = flows.flow_entries(graph, ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1]))
    entries = flows.deduplicated(entries) if direction == "both" else entries
    return entries.withColumn("steps", F.slice("steps", 1, depth)).orderBy(F.length("id"), "id")


def load_manifest(spark: SparkSession, path: str) -> Manifest:
    """A manifest file, as JSON or YAML; the extension says what is tried first."""
    file = Path(path)
    if not file.exists():
        raise AnalysisError(f"no manifest at {path}")
    text = file.read_text(encoding="utf-8")
    if not text.strip():
        raise AnalysisError(f"{path} is empty")
    tries, problems = [json.loads, load_yaml], []
    for read in tries if file.suffix == ".json" else tries[::-1]:
        try:
            d = read(text)
            if not isinstance(d, dict):
                raise ValueError("no mapping")
            return from_dict(spark, d)
        except Exception as e:  # the other form may fit
            problems.append(str(e).splitlines()[0] if str(e) else type(e).__name__)
    raise AnalysisError(f"{path} is no manifest: {'; '.join(problems)}")


def from_dict(spark: SparkSession, d: dict) -> Manifest:
    """A manifest from plain values; sections that are missing are empty."""
    if not {"metadata", "entities", "diagnostics"} <= set(d):
        raise ValueError("metadata, entities and diagnostics are asked for")
    sections = {}
    for name, ddl in SECTIONS.items():
        rows = [json.dumps(r) for r in d.get(name) or []]
        raw = spark.createDataFrame([(r,) for r in rows], "j string")
        sections[name] = raw.select(F.from_json("j", ddl).alias("r")).select("r.*")
    return Manifest(d["metadata"], d.get("summary") or {}, sections)


@dataclass(frozen=True)
class Difference:
    """summary in words; rows by section; whether a new critical finding came."""

    summary: list[str]
    rows: dict[str, DataFrame]
    has_regressions: bool

    @property
    def exit_code(self) -> int:
        return 2 if self.has_regressions else 0


def compare(old: Manifest, new: Manifest, sections: list[str] | None = None) -> Difference:
    """What differs between two manifests' entities and findings, or in the chosen one of these sections."""
    try:
        rows = {k: cut(v) for k, v in diff.diff(old.sections, new.sections, sections).items()}
    except ValueError as e:
        raise AnalysisError(str(e)) from e
    counts = {k: v.select("id").distinct().count() if k == "entities_changed" else v.count() for k, v in rows.items()}
    worse = "diagnostics_new" in rows and not rows["diagnostics_new"].filter("severity = 'critical'").isEmpty()
    return Difference(diff.summary_lines(counts), rows, worse)
