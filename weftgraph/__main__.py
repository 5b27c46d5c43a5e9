"""The command line: analyze, diagnose, trace, diff, init and watch.

Results go to standard output or the file named by --output; everything else goes to standard error. Exit codes: 1 on errors; 2 where
analyze finds something critical (whatever its filters leave out), diagnose reports anything, or diff finds a regression; else 0.
"""

from __future__ import annotations

import argparse
import io
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from weftgraph.plans import analysis, config
from weftgraph.plans.config import AnalysisError
from weftgraph.schemas import CONFIDENCES, SEVERITIES
from weftgraph.sinks import text
from weftgraph.sources.files import detected_languages

log = logging.getLogger("weftgraph")


def _parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-o", "--output", type=Path, help="write to this file instead of standard output")
    common.add_argument("-f", "--format", choices=text.FORMATS, default="yaml")
    loud = common.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="store_true")
    loud.add_argument("-q", "--quiet", action="store_true")
    common.add_argument("-c", "--config", type=Path, help="settings to use instead of the project's own")
    tree = argparse.ArgumentParser(add_help=False)
    tree.add_argument("path", nargs="?", default=".")
    tree.add_argument("-l", "--language", action="append", default=[])
    checks = argparse.ArgumentParser(add_help=False)
    checks.add_argument("--checks", type=lambda s: s.split(","), default=[], help="pattern names, separated by commas")
    checks.add_argument("--severity", choices=SEVERITIES, help="the least severity to report")
    checks.add_argument("--confidence", choices=CONFIDENCES, help="the least confidence to report")
    out = argparse.ArgumentParser(prog="weftgraph", description=__doc__.splitlines()[0])
    sub = out.add_subparsers(dest="command", required=True)
    whole = sub.add_parser("analyze", parents=[common, tree, checks], help="the manifest of a source tree").add_mutually_exclusive_group()
    whole.add_argument("--full", action="store_true", help="analyze everything (the default)")
    whole.add_argument("--incremental", action="store_true", help="accepted; everything is analyzed all the same")
    sub.add_parser("diagnose", parents=[common, tree, checks], help="findings only")
    traced = sub.add_parser("trace", parents=[common, tree], help="call paths of a symbol")
    traced.add_argument("-s", "--symbol", required=True)
    traced.add_argument("-d", "--depth", type=int, default=10)
    traced.add_argument("--direction", choices=analysis.DIRECTIONS, default="forward")
    compared = sub.add_parser("diff", parents=[common], help="differences between two manifest files")
    compared.add_argument("old")
    compared.add_argument("new")
    compared.add_argument("--section", action="append", default=[])
    sub.add_parser("init", parents=[common, tree], help="write settings for a project")
    sub.add_parser("watch", parents=[common, tree], help="not built")
    return out


def _session() -> SparkSession:
    return SparkSession.builder.appName("weftgraph").config("spark.ui.enabled", "false").getOrCreate()


def _root(path: str) -> str:
    """An existing path, in full."""
    found = Path(path)
    if not found.exists():
        raise AnalysisError(f"there is no {path}")
    return str(found.resolve())


def run(args: argparse.Namespace, spark: SparkSession, out: io.TextIOBase) -> int:
    """Carry out one command; what it writes goes to `out`."""
    if args.command == "watch":
        raise AnalysisError("watch is not built; run analyze again when files change")
    if args.command == "diff":
        found = analysis.compare(analysis.load_manifest(spark, args.old), analysis.load_manifest(spark, args.new), args.section)
        text.write_difference(found, args.format, out)
        return found.exit_code
    root = _root(args.path)
    if args.command == "init":
        if not Path(root).is_dir():
            raise AnalysisError(f"{root} is no folder")
        out.write(config.init(Path(root), config.language_names(args.language) or detected_languages(spark, root)))
        return 0
    base = Path(root) if Path(root).is_dir() else Path(root).parent
    settings = config.load_config(base, args.config)
    if args.command == "trace":
        text.write_flows(analysis.trace(spark, root, args.symbol, args.direction, args.depth, settings, args.language), args.format, out)
        return 0
    if args.command == "diagnose":
        graph, _, _ = analysis.graph_of(spark, root, settings, args.language)
        found = analysis.cut(analysis.summary.manifest_entries(analysis.findings(graph, args.checks, args.severity, args.confidence)).orderBy("id"))
        text.write_findings(found, args.format, out)
        return 0 if found.isEmpty() else 2
    if args.incremental:
        log.warning("everything is analyzed; there is no incremental analysis")
    m = analysis.analyze(spark, root, settings, args.language, args.checks, args.severity, args.confidence)
    start = out.tell()
    text.write_manifest(m, args.format, out)
    text.checked_size(out.tell() - start, m.n_bytes, args.format)
    return 2 if m.has_critical else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, format="%(levelname)s %(message)s", force=True)
    log.setLevel(logging.DEBUG if args.verbose else logging.ERROR if args.quiet else logging.WARNING)
    out = io.StringIO()
    try:
        code = run(args, spark or _session(), out)
        if args.output:
            args.output.write_text(out.getvalue(), encoding="utf-8")
        else:
            sys.stdout.write(out.getvalue())
        return code
    except AnalysisError as e:
        log.error("%s", e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
