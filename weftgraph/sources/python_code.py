"""Python source text to rows of symbols, scopes and references."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame

from weftgraph.sources.rows import DEPTH, ROWS, Collector, parse_with

__all__ = ["ROWS", "parse_python", "read_python"]
LANGUAGES = ("python",)
#: A line that starts with one of these goes on with the statement before it.
_GOES_ON = re.compile(r"[\s#)\]}]|(?:else|elif|except|finally|case)\b|$")
_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError)


def _parsed(text: str) -> ast.Module:
    """The tree of a text; of one with errors, that of its statements without them.

    Statements at the left margin are read one by one then, and lines that one cannot have are left out of it: what comes before and after
    an error is kept.
    """
    try:
        return ast.parse(text)
    except _ERRORS:
        pass
    lines, body, at = text.split("\n"), [], 0
    starts = [i for i, line in enumerate(lines) if not _GOES_ON.match(line)]
    starts = [i for k, i in enumerate(starts) if not (k and lines[starts[k - 1]].startswith("@"))]  # a decorator belongs to what follows
    for at, end in zip(starts, [*starts[1:], len(lines)], strict=False):
        tree = _mended(lines[at:end])
        ast.increment_lineno(tree, at)
        body += tree.body
    return ast.Module(body, [])


def _mended(lines: list[str]) -> ast.Module:
    """The tree of one statement, with the lines that stop it replaced by `pass` or by nothing."""
    lines = list(lines)
    for _ in range(2 * len(lines)):
        try:
            return ast.parse("\n".join(lines))
        except _ERRORS as e:
            at = min(max(getattr(e, "lineno", None) or len(lines), 1), len(lines)) - 1
            while at and not lines[at].strip():
                at -= 1
            if not lines[at].strip():
                break
            blank = lines[at][: len(lines[at]) - len(lines[at].lstrip())]
            lines[at] = "" if lines[at].strip() == "pass" else f"{blank}pass"
    return ast.Module([], [])


def _dotted(node: ast.AST) -> str | None:
    """Text of a name or an attribute of one; None for other callees."""
    if isinstance(node, ast.Name):
        return node.id
    return ast.unparse(node) if isinstance(node, ast.Attribute) else None


def _root(node: ast.AST) -> str | None:
    while isinstance(node, ast.Attribute):
        node = node.value
    return node.id if isinstance(node, ast.Name) else None


def _type_root(node: ast.AST | None) -> str | None:
    if isinstance(node, ast.Subscript):
        return _type_root(node.value)
    return _root(node) if node is not None else None


def _place(node: ast.AST) -> dict:
    line = getattr(node, "lineno", 1)
    return {"line": line, "column": getattr(node, "col_offset", 0) + 1, "end_line": getattr(node, "end_lineno", line) or line, "end_column": (getattr(node, "end_col_offset", 0) or 0) + 1}


class Reader(Collector):
    """Reads one file."""

    def __init__(self, file: str, text: str):
        tree = _parsed(text)
        self.lines = text.split("\n")
        super().__init__(file, _place(tree))
        self.imports = {a.asname or a.name for x in ast.walk(tree) if isinstance(x, ast.Import | ast.ImportFrom) for a in x.names}
        for node in tree.body:
            self._visit(node, None, 0, False)

    def _text(self, node: ast.AST) -> str:
        """The source of a node, white space collapsed."""
        a, b = node.lineno - 1, node.end_lineno - 1
        rows = [r.encode("utf-8", "surrogatepass") for r in self.lines[a : b + 1]]  # columns count bytes
        rows[-1] = rows[-1][: node.end_col_offset]
        rows[0] = rows[0][node.col_offset :]
        return b" ".join(b" ".join(rows).split()).decode("utf-8", "surrogatepass")

    def _named(self, kind: str, name: str, node: ast.AST, signature=None, annotations=(), visibility=None) -> str:
        return self.symbol(kind, name, _place(node), visibility or ("Private" if name.startswith("_") else "Public"), signature, annotations)

    def _use(self, tag: str, arg: str, node: ast.AST, owner: str | None) -> None:
        self.ref(tag, arg, _place(node), owner)

    def _signature(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        """The parameters as they stand, and the result's type."""
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]
        if not args:
            shown = "()"
        else:
            shown = f"({ast.unparse(node.args)})" if "#" in "".join(self.lines[node.lineno - 1 : node.body[0].lineno]) else self._between(node)
        return shown + (f" -> {self._text(node.returns)}" if node.returns else "")

    def _between(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        """The text between the round brackets behind the function's name."""
        text = "\n".join(self.lines[node.lineno - 1 : node.body[0].end_lineno])
        text = text.encode("utf-8", "surrogatepass")[node.col_offset :].decode("utf-8", "surrogatepass")
        start = text.index("(", text.index(node.name))
        depth, quote, i = 0, "", start
        while i < len(text):
            c = text[i]
            if quote:
                i += c == "\\"
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            else:
                depth += (c in "([{") - (c in ")]}")
                if not depth:
                    break
            i += 1
        return " ".join(text[start : i + 1].split())

    def _attributes(self, node: ast.AST, owner: str) -> None:
        """`self.name: Type` in a constructor, also inside its control blocks: the type of an instance attribute, if it is a plain name."""
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Attribute) and isinstance(x.target.value, ast.Name) and x.target.value.id == "self" and isinstance(x.annotation, ast.Name):
                self._row("ref", id=self._id("ref", "attr", x.target.attr), kind="Read", tag="instance_attr_type", arg=f"{owner}.{x.target.attr}={x.annotation.id}", **_place(x))
            elif isinstance(x, ast.stmt) and not isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                self._attributes(x, owner)

    def _visit(self, node: ast.AST, owner: str | None, depth: int, typing: bool) -> None:
        if depth > DEPTH:
            return
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            for d in node.decorator_list:
                self._visit(d, owner, depth + 1, typing)
            kind = "Method" if self.stack[-1][0] == "Module" else "Function"
            me = self._named(kind, node.name, node, self._signature(node), [self._text(d) for d in node.decorator_list])
            if kind == "Method" and node.name == "__init__":
                self._attributes(node, self.stack[-1][2])
            self.open("Function", node.name, _place(node))
            args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]
            for t in [a.annotation for a in args] + [node.returns]:
                if name := _type_root(t):
                    self._use("attribute_access", name, t, me)
            for x in [*node.args.defaults, *filter(None, node.args.kw_defaults), *node.body]:
                self._visit(x, me, depth + 1, typing)
            self.close()
            return
        if isinstance(node, ast.ClassDef):
            self._named("Class", node.name, node, None, [self._text(d) for d in node.decorator_list])
            self.open("Module", node.name, _place(node))
            for x in [*node.decorator_list, *node.bases, *node.body]:
                self._visit(x, owner, depth + 1, typing)
            self.close()
            return
        if isinstance(node, ast.Import | ast.ImportFrom):
            module = "." * getattr(node, "level", 0) + (getattr(node, "module", None) or "")
            for a in node.names:
                source = module if isinstance(node, ast.ImportFrom) else a.name
                name = f"*:{source}" if a.name == "*" else a.asname or a.name
                marks = ["import", f"from:{source}"] + ([f"original_name:{a.name}"] if a.asname else []) + (["type_checking_import"] if typing else [])
                self.imported("Module", name, _place(node), "Public", marks, info="star import" if a.name == "*" else "import")
                if typing:
                    self._use("attribute_access", name, node, owner)
            return
        if isinstance(node, ast.Assign | ast.AnnAssign | ast.AugAssign):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if not isinstance(t, ast.Name) or len(self.stack) > 1:
                    continue
                if t.id == "__all__" and isinstance(node.value, ast.List | ast.Tuple):
                    for e in node.value.elts:
                        if isinstance(e, ast.Constant) and isinstance(e.value, str):
                            self._use("attribute_access", e.value, e, owner)
                if not isinstance(node, ast.AugAssign):
                    constant = t.id.upper() == t.id and any(c.isalpha() for c in t.id)
                    self._named("Constant" if constant else "Variable", t.id, t, visibility="Public")
            if isinstance(node, ast.AnnAssign) and (name := _type_root(node.annotation)):
                self._use("attribute_access", name, node.annotation, owner)
        if isinstance(node, ast.Call) and (callee := _dotted(node.func)):
            self._use("call", callee, node, owner)
        if isinstance(node, ast.Attribute) and (name := _root(node)) in self.imports and name:
            self._use("attribute_access", name, node, owner)
            return
        inside = typing or isinstance(node, ast.If) and ast.unparse(node.test) in ("TYPE_CHECKING", "typing.TYPE_CHECKING")
        other = node.orelse if isinstance(node, ast.If) else []
        for child in ast.iter_child_nodes(node):
            self._visit(child, owner, depth + 1, typing if child in other else inside)


def read_python(file: str, text: str) -> list[dict]:
    """Rows of one file; a text with errors gives those of its statements without them."""
    return Reader(file, text).done()


def parse_python(files: DataFrame) -> DataFrame:
    """Rows of all Python files (rel_path, language, content), told apart by row_kind."""
    return parse_with(files, LANGUAGES, lambda file, language, text: read_python(file, text))
