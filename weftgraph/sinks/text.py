"""Writers of manifests, findings, traces and differences.

Each writes to an open text file, section by section and row by row (DataFrame.toLocalIterator), so the
driver never holds a whole section. Tables for further work are written by write_tables(), by the executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame, Row

from weftgraph.plans.analysis import VERSION, Difference, Manifest
from weftgraph.plans.config import AnalysisError

FORMATS = ("yaml", "json", "sarif", "summary")
#: Levels of severities, the schema and version of the format.
LEVELS = {"critical": "error", "warning": "warning", "info": "note"}
SARIF_SCHEMA, SARIF_VERSION = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json", "2.1.0"
#: Sources under SMALL_SOURCE bytes or texts under SMALL_TEXT are not judged; largest ratio of a text to its source.
SMALL_SOURCE, SMALL_TEXT, RATIOS = 1024, 20480, {"yaml": 10.0, "json": 15.0, "sarif": 20.0, "summary": float("inf")}
SHOWN = 10


def _plain(v):
    """Rows as dicts, without the optional fields that are null."""
    if isinstance(v, Row):
        return {k: _plain(x) for k, x in v.asDict().items() if not (x is None and k in ("location", "context"))}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def rows_of(df: DataFrame) -> Iterator[dict]:
    return map(_plain, df.toLocalIterator())


def _indented(text: str, by: str) -> str:
    return ("\n" + by).join(text.splitlines())


def _json_list(rows: Iterable, out: TextIO, by: str) -> None:
    first = True
    for r in rows:
        out.write(("[" if first else ",") + "\n" + by + "  " + _indented(json.dumps(r, indent=2, ensure_ascii=False), by + "  "))
        first = False
    out.write("[]" if first else "\n" + by + "]")


def _json_object(fields: dict, out: TextIO, by: str = "") -> None:
    """Pretty JSON of a mapping whose values are plain or iterators of plain values."""
    out.write("{")
    for k, (name, value) in enumerate(fields.items()):
        out.write(("," if k else "") + f'\n{by}  "{name}": ')
        if isinstance(value, Iterator):
            _json_list(value, out, by + "  ")
        elif callable(value):
            value(out, by + "  ")
        else:
            out.write(_indented(json.dumps(value, indent=2, ensure_ascii=False), by + "  "))
    out.write("\n" + by + "}")


def _yaml(value) -> str:
    """YAML text; without the optional package the JSON form, which is YAML too."""
    try:
        import yaml
    except ModuleNotFoundError:
        return json.dumps(value, indent=2, ensure_ascii=False) + "\n"
    return yaml.safe_dump(value, sort_keys=False, allow_unicode=True, width=1 << 20)


def _yaml_object(fields: dict, out: TextIO) -> None:
    for name, value in fields.items():
        if isinstance(value, Iterator):
            first = True
            for r in value:
                out.write(f"{name}:\n" if first else "")
                text = _yaml([r])
                out.write(text if not text.startswith("[") else "- " + json.dumps(r, ensure_ascii=False) + "\n")
                first = False
            out.write(f"{name}: []\n" if first else "")
        else:
            out.write(_yaml({name: value}) if not _yaml({name: value}).startswith("{") else f"{name}: {json.dumps(value, ensure_ascii=False)}\n")


def split_location(loc: str) -> tuple[str, int | None]:
    """(file, line) of `file:line`; without a number behind the last colon the whole is the file."""
    file, colon, line = loc.rpartition(":")
    return (file, int(line)) if colon and line.isdigit() else (loc, None)


def _place(loc: str) -> dict:
    file, line = split_location(loc)
    return {"physicalLocation": {"artifactLocation": {"uri": file}} | ({"region": {"startLine": line}} if line is not None else {})}


def sarif_result(d: dict) -> dict:
    """One finding as a result; evidence with a place is related to it under its number."""
    related = [{"id": i, **_place(e["location"]), "message": {"text": e["observation"]}} for i, e in enumerate(d["evidence"] or [], 1) if e.get("location") is not None]
    out = {"ruleId": d["pattern"], "level": LEVELS.get(d["severity"], "warning"), "message": {"text": d["message"]}, "locations": [_place(d["loc"] or "")]}
    return out | ({"relatedLocations": related} if related else {})


def _sarif(rules: list[dict], results: Iterator[dict], out: TextIO) -> None:
    driver = {"name": "weftgraph", "version": VERSION} | ({"rules": rules} if rules is not None else {})

    def run(out: TextIO, by: str) -> None:
        out.write("[\n" + by + "  ")
        _json_object({"tool": {"driver": driver}, "results": results}, out, by + "  ")
        out.write("\n" + by + "]")

    _json_object({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": run}, out)
    out.write("\n")


def _rules(found: DataFrame) -> list[dict]:
    """A rule for each pattern, in order of first findings; there are as many as patterns."""
    seen = found.groupBy("pattern").agg({"id": "min"}).withColumnRenamed("min(id)", "first").orderBy("first").collect()
    return [{"id": r["pattern"], "shortDescription": {"text": r["pattern"].replace("_", " ")}} for r in seen]


def _shown(d: dict) -> str:
    return f"[{(d['severity'] or '').upper()}] {d['pattern']}: {d['message']} ({d['loc']})"


def _head(df: DataFrame, n: int) -> tuple[list[dict], int]:
    """The first n rows, and how many more there are."""
    rows = [_plain(r) for r in df.limit(n + 1).collect()]
    return rows[:n], (df.count() - n if len(rows) > n else 0)


def write_summary(m: Manifest, out: TextIO) -> None:
    """A page of plain text."""
    meta, about, counts = m.metadata, m.summary, m.summary["diagnostic_summary"]
    lines = [f"weftgraph analysis of {meta['project']}", f"version {meta['tool_version']}, {meta['analyzed_at']}", ""]
    lines += ["== Overview ==", f"files: {meta['file_count']}, entities: {meta['entity_count']}, flows: {meta['flow_count']}, findings: {meta['diagnostic_count']}"]
    lines += [f"languages: {', '.join(meta['languages'])}"] if meta["languages"] else []
    lines += ["", "== Architecture ==", about["architecture"]] if about["architecture"] else []
    if counts["critical"] or counts["warning"] or counts["info"]:
        lines += ["", "== Findings by severity ==", f"critical: {counts['critical']}, warning: {counts['warning']}, info: {counts['info']}"]
        lines += [f"  {i}. {text}" for i, text in enumerate(counts["top_issues"][:5], 1)]
    if about["modules"]:
        more = len(about["modules"]) - SHOWN
        lines += ["", "== Modules ==", *(f"  {x['name']} ({x['entity_count']} entities): {x['role']}" for x in about["modules"][:SHOWN])]
        lines += [f"  ... and {more} more"] if more > 0 else []
    lines += ["", "== Entry points ==", *(f"  {x}" for x in about["entry_points"])] if about["entry_points"] else []
    rows, more = _head(m.sections["diagnostics"], SHOWN)
    lines += ["", "== Findings ==", *(f"  {_shown(d)}" for d in rows)] if rows else []
    lines += [f"  ... and {more} more"] if more else []
    out.write("\n".join([*lines, ""]))


def write_manifest(m: Manifest, form: str, out: TextIO) -> None:
    """A manifest as YAML, JSON, SARIF (its findings) or a summary."""
    fields = {"metadata": m.metadata, "summary": m.summary, **{k: rows_of(v) for k, v in m.sections.items()}}
    if form == "json":
        _json_object(fields, out)
        out.write("\n")
    elif form == "yaml":
        _yaml_object(fields, out)
    elif form == "sarif":
        _sarif(_rules(m.sections["diagnostics"]), map(sarif_result, rows_of(m.sections["diagnostics"])), out)
    elif form == "summary":
        write_summary(m, out)
    else:
        raise AnalysisError(f"unknown format {form!r}; known: {', '.join(FORMATS)}")


def write_findings(found: DataFrame, form: str, out: TextIO) -> None:
    """Findings alone."""
    if form == "json":
        _json_list(rows_of(found), out, "")
        out.write("\n")
    elif form == "yaml":
        empty = True
        for r in rows_of(found):
            text = _yaml([r])
            out.write(text if not text.startswith("[") else "- " + json.dumps(r, ensure_ascii=False) + "\n")
            empty = False
        out.write("[]\n" if empty else "")
    elif form == "sarif":
        _sarif(_rules(found), map(sarif_result, rows_of(found)), out)
    elif form == "summary":
        n = {r["severity"]: r["count"] for r in found.groupBy("severity").count().collect()}
        out.write(f"{sum(n.values())} finding(s)\n")
        if n:
            out.write(", ".join(f"{s}: {n.get(s, 0)}" for s in LEVELS) + "\n\n")
        for d in rows_of(found):
            out.write(_shown(d) + "\n" + (f"  fix: {d['suggestion']}\n" if d["suggestion"] else ""))
    else:
        raise AnalysisError(f"unknown format {form!r}; known: {', '.join(FORMATS)}")


def _flow_result(f: dict) -> dict:
    steps = [{"entity": s["entity"], "action": s["action"]} for s in f["steps"]]
    return {"ruleId": "flow-trace", "message": {"text": f["description"]}, "properties": {"entry": f["entry"], "exit": f["exit"], "steps": steps}}


def write_flows(entries: DataFrame, form: str, out: TextIO) -> None:
    """Traced flows."""
    if form == "sarif":
        _sarif(None, map(_flow_result, rows_of(entries)), out)
    elif form == "summary":
        n = 0
        for n, f in enumerate(rows_of(entries), 1):
            out.write(f"{f['id']}: {f['description']}\n" + "".join(f"  -> {s['entity']}\n" for s in f["steps"]))
        out.write(f"{n} flow(s)\n")
    elif form == "json":
        _json_list(rows_of(entries), out, "")
        out.write("\n")
    else:
        write_findings(entries, form, out)


def write_difference(d: Difference, form: str, out: TextIO) -> None:
    """A difference; there is no SARIF form of it."""
    keys = {"entities_added": "id", "entities_removed": "id"}

    def listed(name: str) -> Iterator:
        df = d.rows[name]
        if name in keys:
            return iter(r["id"] for r in df.orderBy("id").toLocalIterator())
        if name == "entities_changed":
            return _changes(df)
        return rows_of(df.select("pattern", "entity", "loc", "severity", "message").orderBy("pattern", "entity", "loc"))

    if form in ("json", "yaml"):
        fields = {"summary": d.summary, **{k: listed(k) for k in d.rows}, "has_regressions": d.has_regressions}
        if form == "json":
            _json_object(fields, out)
            out.write("\n")
        else:
            _yaml_object(fields, out)
    elif form == "summary":
        signs: dict[str, tuple[str, Callable]] = {
            "entities_added": ("Entities added", lambda x: f"  + {x}\n"), "entities_removed": ("Entities removed", lambda x: f"  - {x}\n"),
            "entities_changed": ("Entities changed", lambda x: f"  ~ {x['id']}\n" + "".join(f"    {c['field']}: {c['old']} -> {c['new']}\n" for c in x["changes"])),
            "diagnostics_new": ("New findings", lambda x: f"  + {x['pattern']} on {x['entity']} at {x['loc']}\n"), "diagnostics_resolved": ("Resolved findings", lambda x: f"  - {x['pattern']} on {x['entity']} at {x['loc']}\n"),
        }
        out.write("Difference:\n" + "".join(f"  {x}\n" for x in d.summary))
        for name in d.rows:
            for k, x in enumerate(listed(name)):
                out.write(("" if k else f"\n{signs[name][0]}:\n") + signs[name][1](x))
    else:
        raise AnalysisError(f"a difference cannot be written as {form}")


def _changes(df: DataFrame) -> Iterator[dict]:
    """The changed fields of each entity together."""
    now: dict | None = None
    for r in df.orderBy("id", "field").toLocalIterator():
        if now is None or now["id"] != r["id"]:
            if now:
                yield now
            now = {"id": r["id"], "changes": []}
        now["changes"].append({"field": r["field"], "old": r["old"], "new": r["new"]})
    if now:
        yield now


def checked_size(n_text: int, n_source: int, form: str) -> None:
    """Refuse a text that is out of proportion to its source; small ones pass."""
    limit = RATIOS.get(form, RATIOS["yaml"])
    if n_source >= SMALL_SOURCE and n_text >= SMALL_TEXT and n_text / n_source > limit:
        raise AnalysisError(f"the {form} text has {n_text} bytes for {n_source} bytes of source, more than {limit:g} times as many")


def write_tables(m: Manifest, path: str, form: str = "parquet") -> None:
    """Each section as a table below path, and metadata and summary as one row each: written by the executors, for manifests of any size."""
    spark = next(iter(m.sections.values())).sparkSession
    from weftgraph.plans.analysis import METADATA, SUMMARY

    for name, df in m.sections.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")
    for name, ddl, value in (("metadata", METADATA, m.metadata), ("summary", SUMMARY, m.summary)):
        one = spark.createDataFrame([(json.dumps(value),)], "j string")
        one.selectExpr(f"from_json(j, '{ddl}') AS r").select("r.*").write.mode("overwrite").format(form).save(f"{path}/{name}")
