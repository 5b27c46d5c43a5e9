"""Tokens of languages with curly brackets, for front-ends that read names and brackets and pass over the rest.

Nothing here fails on broken text: an unclosed comment or bracket goes to the end, and a stray quote or closing bracket is a mark by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

OPEN, CLOSE = "([{", ")]}"
_NAME = r"[^\W\d]\w*"
#: What may stand before a slash that starts a pattern, beside punctuation.
_BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_SCRIPT = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<tick>`)"
    r"|(?P<number>\d[\w.]*)|(?P<name>#?(?:\$|" + _NAME + r")(?:[\w$])*)|(?P<mark>=>|\?\.(?!\d)|\.\.\.|&&|\|\||\?\?|[^\s\w])",
    re.DOTALL,
)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/[a-z]*")
_RUST = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*)|(?P<nested>/\*)|(?P<raw>b?r(?P<hashes>#*)\".*?\"(?P=hashes))|(?P<string>b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\\n])')"
    r"|(?P<life>'" + _NAME + r")|(?P<number>\d[\w]*(?:\.\d[\w]*)?)|(?P<name>(?:r#)?" + _NAME + r")|(?P<mark>::|->|=>|\.\.=?|[^\s\w])",
    re.DOTALL,
)


@dataclass(slots=True)
class Token:
    kind: str  # name, string, number, mark or other
    text: str
    start: int
    end: int


class Tokens:
    """The tokens of a text, the partner of every bracket, and places as lines and columns from 1."""

    def __init__(self, text: str, rust: bool = False):
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.all: list[Token] = []
        (self._rust if rust else self._script)(0, 0)
        self.partner = self._partners()

    def __len__(self) -> int:
        return len(self.all)

    def __getitem__(self, i: int) -> Token:
        return self.all[i]

    def is_(self, i: int, *texts: str) -> bool:
        """Whether token i is there, no literal, and one of the texts."""
        return 0 <= i < len(self.all) and self.all[i].kind in ("name", "mark") and self.all[i].text in texts

    def name(self, i: int) -> str | None:
        return self.all[i].text if 0 <= i < len(self.all) and self.all[i].kind == "name" else None

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.all[i].start)

    def place(self, a: int, b: int) -> dict:
        """From the start of token a to the end of token b."""
        b = min(max(a, b), len(self.all) - 1)
        (l1, c1), (l2, c2) = (self._at(p) for p in (self.all[a].start, self.all[b].end))
        return {"line": l1, "column": c1, "end_line": l2, "end_column": c2}

    def _at(self, p: int) -> tuple[int, int]:
        line = bisect_right(self.lines, p)
        return line, p - self.lines[line - 1] + 1

    def whole(self) -> dict:
        line, column = self._at(len(self.text))
        return {"line": 1, "column": 1, "end_line": line, "end_column": column}

    def slice(self, a: int, b: int) -> str:
        """The text from token a to token b (exclusive), white space collapsed."""
        return " ".join(self.text[self.all[a].start : self.all[b - 1].end].split()) if b > a else ""

    def after(self, i: int) -> int:
        """The token behind i, or behind the bracket that i opens."""
        return self.partner.get(i, i) + 1

    def angled(self, i: int) -> int:
        """The token behind the angle brackets that open at i; i itself if they do not close before a bracket or mark that types lack."""
        depth, j = 0, i
        while j < len(self.all):
            if self.is_(j, "<"):
                depth += 1
            elif self.is_(j, ">"):
                depth -= 1
                if not depth:
                    return j + 1
            elif self.is_(j, ";", ")", "]", "}"):
                break
            j = self.after(j) if self.is_(j, *OPEN) else j + 1
        return i

    def _script(self, at: int, depth: int, inner: bool = False) -> int:
        """Read on from `at`; inner: up to the bracket that ends a template's expression."""
        text, level = self.text, 0
        while at < len(text):
            before = self.all[-1] if self.all else None
            ends = before is not None and (before.kind in ("number", "string", "other") or before.kind == "name" and before.text not in _BEFORE_PATTERN or before.text in (")", "]", "}"))
            if text[at] == "/" and not ends and not text.startswith(("//", "/*"), at) and (m := _PATTERN.match(text, at)):
                self.all.append(Token("other", m[0], at, m.end()))
                at = m.end()
                continue
            m = _SCRIPT.match(text, at)
            if m is None:  # a character of no class
                at += 1
                continue
            kind, at = m.lastgroup, m.end()
            if kind == "tick":
                at = self._template(m.start(), depth)
            elif kind not in ("space", "comment"):
                if inner and kind == "mark":
                    level += (m[0] == "{") - (m[0] == "}")
                    if level < 0:
                        return at
                self.all.append(Token(kind, m[0], m.start(), at))
        return at

    def _template(self, start: int, depth: int) -> int:
        """A template literal; the tokens of its expressions stand in round brackets."""
        text, at, token = self.text, start + 1, Token("other", "`", start, start + 1)
        self.all.append(token)
        while at < len(text) and text[at] != "`":
            if text[at] == "\\":
                at += 2
            elif text.startswith("${", at) and depth < 32:
                self.all.append(Token("mark", "(", at, at + 2))
                at = self._script(at + 2, depth + 1, inner=True)
                self.all.append(Token("mark", ")", max(at - 1, 0), at))
            else:
                at += 1
        at = min(at + 1, len(text))
        self.all.append(Token("other", "`", at - 1, at))
        return at

    def _rust(self, at: int, depth: int) -> int:
        text = self.text
        while at < len(text):
            m = _RUST.match(text, at)
            if m is None:
                at += 1
                continue
            kind, at = m.lastgroup, m.end()
            if m["raw"] is not None:
                kind = "string"
            if kind == "nested":
                level = 1
                while level and (n := re.compile(r"/\*|\*/").search(text, at)):
                    level, at = level + (1 if n[0] == "/*" else -1), n.end()
                at = at if not level else len(text)
            elif kind not in ("space", "comment"):
                word = m[0].removeprefix("r#") if kind == "name" else m[0]
                self.all.append(Token({"life": "other"}.get(kind, kind), word, m.start(), at))
        return at

    def _partners(self) -> dict[int, int]:
        out: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.all):
            if t.kind != "mark":
                continue
            if t.text in OPEN:
                stack.append(i)
            elif t.text in CLOSE:
                wanted = OPEN[CLOSE.index(t.text)]
                if any(self.all[j].text == wanted for j in stack[-64:]):
                    while (j := stack.pop()) is not None:
                        out[j] = i  # what stands unclosed inside ends here too
                        if self.all[j].text == wanted:
                            break
        for j in stack:
            out[j] = len(self.all)
        return out
