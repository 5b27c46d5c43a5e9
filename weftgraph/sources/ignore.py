"""Ignore files of version control as a predicate over relative paths."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    regex: str  # over a whole relative path
    ignore: bool
    folders: bool  # folders only


def _translated(glob: str) -> str:
    """A glob over path parts as a regular expression; a bracket that is not closed stands for itself."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif glob[i] == "*":
            out += "[^/]*"
            i += 1
            while i < len(glob) and glob[i] == "*":
                i += 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            i += glob[i] == "\\" and i + 1 < len(glob)
            out, i = out + re.escape(glob[i]), i + 1
    return out


def rules_of(text: str, folder: str = "") -> list[Rule]:
    """The rules of one ignore file that lies in a folder (relative, "" for the root), in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        ignore = not line.startswith("!")
        line = line[not ignore :]
        folders, line = line.endswith("/"), line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        below = re.escape(folder) + "/" if folder else ""
        out.append(Rule(f"^{below}{'' if anchored else '(?:.*/)?'}{_translated(line.lstrip('/'))}$", ignore, folders))
    return out


def ordered(files: dict[str, str]) -> list[Rule]:
    """All rules from the weakest to the strongest: texts by relative path of the ignore file; deeper ones are stronger."""
    out = []
    for path in sorted(files, key=lambda p: (p.count("/"), p)):
        out += rules_of(files[path], path.rpartition("/")[0])
    return out


def ignored(rel: Column, rules: list[Rule]) -> Column:
    """Whether the strongest rule that matches a path, or one of the folders above it, says so."""
    if not rules:
        return F.lit(False)

    def verdict(path: Column, folder: bool) -> Column:
        out = None
        for r in reversed([r for r in rules if folder or not r.folders]):
            out = F.when(path.rlike(r.regex), F.lit(r.ignore)) if out is None else out.when(path.rlike(r.regex), F.lit(r.ignore))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))

    parts = F.split(rel, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return verdict(rel, False) | (F.size(parts) > 1) & F.exists(above, lambda p: verdict(p, True))


def user_rules() -> str:
    """The text of the user's own ignore file, if there is one."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    try:
        with open(os.path.join(home, "git", "ignore"), encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""
