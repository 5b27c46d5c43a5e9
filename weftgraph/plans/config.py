"""Project settings: languages and excluded globs, from `.weftgraph/config.yaml` or a file that is named."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from pathlib import Path

log = logging.getLogger("weftgraph")
FOLDER, FILE = ".weftgraph", "config.yaml"
#: Names under which a language may be asked for.
ALIASES = {"python": "python", "py": "python", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "rust": "rust", "rs": "rust"}


class AnalysisError(Exception):
    """Something the user can mend; the message says what."""


@dataclass(frozen=True)
class Config:
    languages: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    path: Path | None = None


def load_yaml(text: str):
    """YAML text as plain values; without the optional package it cannot be read."""
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise AnalysisError("reading YAML needs the package PyYAML") from e
    return yaml.safe_load(text)


def load_config(root: Path, named: Path | None = None) -> Config:
    """Settings of a project. A named file must exist; text that cannot be read as settings means the defaults, with a warning."""
    path = named or root / FOLDER / FILE
    if not path.exists():
        if named:
            raise AnalysisError(f"no config file at {named}; name another one, or leave --config out")
        return Config()
    try:
        found = load_yaml(path.read_text(encoding="utf-8"))
    except Exception as e:  # whatever the parser raises
        log.warning("%s cannot be read as settings, defaults are used: %s", path, e)
        return Config(path=path)
    if found is None:
        return Config(path=path)
    lists = [found.get(k) or [] if isinstance(found, dict) else None for k in ("languages", "exclude")]
    if not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in lists):
        log.warning("%s does not hold lists of names, defaults are used", path)
        return Config(path=path)
    return Config(lists[0], lists[1], path)


def language_names(asked: list[str]) -> list[str]:
    """Names of languages, with aliases; unknown ones are refused."""
    out = []
    for name in asked:
        if name.lower() not in ALIASES:
            raise AnalysisError(f"unknown language {name!r}; known: {', '.join(sorted(set(ALIASES.values())))}")
        if ALIASES[name.lower()] not in out:
            out.append(ALIASES[name.lower()])
    return out


def adapters(languages: list[str]) -> list[str]:
    """The languages that are parsed: one front-end reads JavaScript and TypeScript, so asking for one means both."""
    both = {"javascript", "typescript"}
    return [*languages, *sorted(both - set(languages))] if both & set(languages) else list(languages)


def written_config(languages: list[str]) -> str:
    """The text of a new settings file."""
    lines = ["# Languages to analyze; all that are found if none is named.", "languages:" + ("" if languages else " []"), *(f"  - {x}" for x in languages)]
    return "\n".join([*lines, "# Globs of paths, file names or folders to leave out.", "exclude: []", ""])


def init(root: Path, languages: list[str]) -> str:
    """The text of a project's settings; they are written if there are none yet, and never overwritten."""
    if not root.is_dir():
        raise AnalysisError(f"{root} is no folder")
    path = root / FOLDER / FILE
    if path.exists():
        return path.read_text(encoding="utf-8")
    path.parent.mkdir(exist_ok=True)
    path.write_text(written_config(languages), encoding="utf-8")
    return path.read_text(encoding="utf-8")
