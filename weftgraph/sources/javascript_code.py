"""JavaScript and TypeScript text to rows of symbols, scopes and references."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftgraph.sources.rows import DEPTH, Collector, parse_with
from weftgraph.sources.tokens import OPEN, Tokens

LANGUAGES = ("javascript", "typescript")
_NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "with", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "instanceof", "import"}
_STARTS = {"const", "let", "var", "function", "class", "import", "export", "return", "if", "for", "while", "switch", "try", "throw", "async", "interface", "type", "enum", "declare", "abstract", "namespace"}
_MODIFIERS = {"static", "async", "public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor"}
#: Marks after which a value is still to come.
_OPEN_ENDED = {"=", "(", ",", ":", "=>", "?", "&&", "||", "??", "+", "-", "*", "/", "%", "!", "&", "|", "^", "~", "<", ">", "[", "...", "."}


class ScriptReader(Collector):
    """Reads one file; typed: with TypeScript's own declarations."""

    def __init__(self, file: str, text: str, typed: bool):
        self.t, self.typed = Tokens(text), typed
        super().__init__(file, self.t.whole())
        self.exported_names: list[str] = []
        self._scan(0, len(self.t), None, 0)
        for name in self.exported_names:  # `export { name }` shows the first symbol of that name
            for r in self.rows:
                if r["row_kind"] == "symbol" and r["name"] == name:
                    r["visibility"] = "Public"
                    break

    # statements and expressions

    def _scan(self, i: int, end: int, owner: str | None, depth: int) -> None:
        """Declarations and calls among the tokens i to end."""
        t, shown = self.t, False
        if depth > DEPTH:
            return
        while i < end:
            word = t.name(i)
            fresh = self._begins(i)
            if word == "export" and fresh:
                j = self._export(i)
                shown = j == i + 1 or t.is_(j - 1, "default")
                i = j
                continue
            nxt = None
            if word == "import" and fresh and not t.is_(i + 1, "(", "."):
                nxt = self._import(i, end)
            elif word == "function" and (fresh or shown or self._begins(i - 1) and t.is_(i - 1, "async")):
                nxt = self._function(i, end, owner, depth, shown)
            elif word == "class" and (fresh or shown or t.is_(i - 1, "abstract", "declare")):
                nxt = self._class(i, end, owner, depth, shown)
            elif word in ("const", "let", "var") and t.is_(i + 1, "enum") and self.typed:
                i += 1
                continue
            elif word in ("const", "let", "var"):
                nxt = self._declarators(i + 1, end, owner, depth, shown)
            elif self.typed and word in ("interface", "enum", "type") and t.name(i + 1) and (fresh or shown or t.is_(i - 1, "declare", "const")):
                nxt = self._type_only(i, end, shown)
            elif word and t.is_(self._generic(i + 1), "(") and word not in _NO_CALL:
                self._call(i, owner)
            if shown and word in ("async", "abstract", "declare") and nxt is None:
                i += 1  # the export still holds for what follows
                continue
            shown = False
            i = nxt if nxt is not None else i + 1

    def _begins(self, i: int) -> bool:
        """Whether a statement may begin at token i."""
        t = self.t
        if i <= 0 or t.is_(i - 1, ";", "{", "}", "default") or t.is_(i - 1, "async", "declare", "abstract", "export") and self._begins(i - 1):
            return True
        before = t[i - 1]
        return t.line(i) > t.line(i - 1) and not (before.kind == "mark" and before.text in _OPEN_ENDED)

    def _generic(self, i: int) -> int:
        """Behind type arguments at i, if a bracket follows them."""
        if self.typed and self.t.is_(i, "<"):
            j = self.t.angled(i)
            return j if self.t.is_(j, "(") else i
        return i

    def _call(self, i: int, owner: str | None) -> None:
        """A call whose callee ends at token i: a name, or names joined by points."""
        t, a, parts = self.t, i, [t_text(self.t, i)]
        while t.is_(a - 1, ".", "?.") and t.name(a - 2):
            a -= 2
            parts.insert(0, t_text(t, a))
        if t.is_(a - 1, ".", "?.", "new", "function") or t.is_(a - 2, "function") and t.is_(a - 1, "*"):
            return
        self.ref("call", ".".join(parts), t.place(a, t.partner.get(self._generic(i + 1), i + 1)), owner)

    def _end_of_value(self, i: int, end: int) -> int:
        """Behind the expression that begins at i: a comma, a semicolon, or a line that begins something else."""
        t, start = self.t, i
        while i < end and not t.is_(i, ",", ";", ")", "]", "}"):
            if i > start and t.line(i) > t.line(i - 1) and not (t[i - 1].kind == "mark" and t[i - 1].text in _OPEN_ENDED) and (t[i].kind != "mark" or t.is_(i, "@", "#")) and not t.is_(i, "instanceof", "in"):
                break
            i = t.after(i) if t.is_(i, *OPEN) else i + 1
        return min(i, end)

    def _past_type(self, i: int, end: int, *stops: str) -> int:
        """Behind a type annotation at i (a colon), up to one of the marks."""
        t = self.t
        if not t.is_(i, ":"):
            return i
        i += 1
        while i < end and not t.is_(i, *stops):
            if t.is_(i, "{") and "{" not in stops or t.is_(i, "(", "["):
                i = t.after(i)
            elif t.is_(i, "<"):
                i = max(t.angled(i), i + 1)
            else:
                i += 1
        return i

    # functions

    def _signature(self, i: int) -> str:
        """The parameters in brackets at i, without types."""
        t, close = self.t, self.t.partner.get(i, i)
        if not self.typed:
            return t.slice(i, min(close + 1, len(t)))
        out, a, j = "", i, i + 1
        while j < close:
            if t.is_(j, ":") or t.is_(j, "?") and t.is_(j + 1, ":"):
                out += self.t.text[t[a].start : t[j - 1].end]
                j = self._past_type(j + t.is_(j, "?"), close, ",", "=")
                a = j
                out += " " if t.is_(j, "=") else ""
            else:
                j = t.after(j) if t.is_(j, *OPEN) else j + 1
        out += self.t.text[t[a].start : t[min(close, len(t) - 1)].end]
        return " ".join(out.split())

    def _body(self, i: int, end: int) -> int | None:
        """The bracket that opens a function's body behind the parameters that open at i; None if there is none."""
        t = self.t
        j = t.after(i)
        if t.is_(j, ":"):
            if t.is_(j + 1, "{"):  # the result is an object type
                j = t.after(j + 1)
            j = j if t.is_(j, "{") else self._past_type(j if t.is_(j, ":") else j - 1, end, "{", ";", "=>") if t.is_(j, ":") else j
        return j if t.is_(j, "{") else None

    def _callable(self, kind: str, name: str, first: int, params: int | None, body: int, last: int, owner, depth: int, visibility: str, signature: str) -> None:
        """A symbol with a scope; what its parameters and body use is its own."""
        place = self.t.place(first, last)
        me = self.symbol(kind, name, place, visibility, signature)
        self.open("Function", name, place)
        if params is not None:
            self._scan(params + 1, self.t.partner.get(params, params), me, depth + 1)
        self._scan(body, last + 1, me, depth + 1)
        self.close()

    def _function(self, i: int, end: int, owner, depth: int, shown: bool) -> int | None:
        t = self.t
        at = i + 1 + t.is_(i + 1, "*")
        name = t.name(at)
        if not name:
            return None
        params = t.angled(at + 1) if t.is_(at + 1, "<") else at + 1
        if not t.is_(params, "("):
            return None
        body = self._body(params, end)
        first = i - 1 if t.is_(i - 1, "async") else i
        if body is None:  # an overload, or a declaration without a body
            if self.typed and t.is_(i - 1, "declare"):
                self._at_line(i, "Function", name, shown or t.is_(i - 2, "export"), ["declare"])
            return self._end_of_value(t.after(params), end)
        last = min(t.partner[body], len(t) - 1)
        self._callable("Function", name, first, params, body + 1, last, owner, depth, "Public" if shown else "Private", self._signature(params))
        return last + 1

    def _declarators(self, i: int, end: int, owner, depth: int, shown: bool) -> int:
        """What const, let or var declares: functions and required modules are symbols, other values are passed over for calls."""
        t = self.t
        while i < end:
            target, name = i, t.name(i)
            i = t.after(i) if t.is_(i, "{", "[") else i + 1
            i = self._past_type(i, end, "=", ",", ";") if self.typed else i
            if not t.is_(i, "="):
                if not t.is_(i, ","):
                    return i
                i += 1
                continue
            value = i + 1
            stop = self._end_of_value(value, end)
            if not self._required(target, value, stop) and not (name and self._function_value(name, target, value, stop, owner, depth, shown)):
                self._scan(value, stop, owner, depth + 1)
            if not t.is_(stop, ","):
                return stop
            i = stop + 1
        return i

    def _function_value(self, name: str, target: int, value: int, stop: int, owner, depth: int, shown: bool) -> bool:
        """Whether the value is a function; then its symbol is made."""
        t, visibility = self.t, "Public" if shown else "Private"
        i = value + t.is_(value, "async")
        if t.is_(i, "function"):
            params = i + 1 + t.is_(i + 1, "*")
            params += t.name(params) is not None
            body = self._body(params, stop) if t.is_(params, "(") else None
            if body is None:
                return False
            last = min(t.partner[body], len(t) - 1)
            self._callable("Function", name, target, params, body + 1, last, owner, depth, visibility, self._signature(params))
            return True
        params = t.angled(i) if t.is_(i, "<") else i
        if t.is_(params, "("):
            arrow = self._past_type(t.after(params), stop, "=>", ";")
        elif t.name(params):
            arrow = params + 1
        else:
            return False
        if not t.is_(arrow, "=>"):
            return False
        single = not t.is_(params, "(")
        self._callable("Function", name, target, None if single else params, arrow + 1, stop - 1, owner, depth, visibility, t.slice(params, params + 1) if single else self._signature(params))
        return True

    def _required(self, target: int, value: int, stop: int) -> bool:
        """`= require('literal')`: a module by the variable's name, or a variable for each name taken out of it."""
        t = self.t
        if not (t.is_(value, "require") and t.is_(value + 1, "(") and value + 2 < stop and t[value + 2].kind == "string" and t.is_(value + 3, ")")):
            return False
        source, place = t[value + 2].text[1:-1], t.place(target, value + 3)
        if name := t.name(target):
            self.imported("Module", name, place, "Private", ["import", *_from(source)], infix=("import",))
        elif t.is_(target, "{"):
            for wanted, own in self._pairs(target, ":"):
                self.imported("Variable", own, place, "Private", ["import", *_from(source), *_original(wanted, own)], infix=("import",))
        return True

    # classes

    def _class(self, i: int, end: int, owner, depth: int, shown: bool) -> int | None:
        t, name = self.t, self.t.name(i + 1)
        if not name or name == "extends":
            return None
        body = i + 2
        while body < end and not t.is_(body, "{", ";"):
            body = max(t.angled(body), body + 1) if t.is_(body, "<") else t.after(body) if t.is_(body, "(", "[") else body + 1
        if not t.is_(body, "{"):
            return None
        last = min(t.partner[body], len(t) - 1)
        place = t.place(i - 1 if t.is_(i - 1, "abstract") else i, last)
        self.symbol("Class", name, place, "Public" if shown else "Private")
        self._scan(i + 2, body, owner, depth + 1)  # what it extends may be a call
        self.open("Module", name, place)
        self._members(body + 1, last, owner, depth + 1)
        self.close()
        return last + 1

    def _members(self, i: int, end: int, owner, depth: int) -> None:
        t = self.t
        while i < end:
            if t.is_(i, "@"):  # a decorator
                stop = i + 2
                while t.is_(stop, "."):
                    stop += 2
                stop = t.after(stop) if t.is_(stop, "(") else stop
                self._scan(i + 1, stop, owner, depth)
                i = stop
                continue
            if t.is_(i, ";", ","):
                i += 1
                continue
            first, prefix = i, ""
            while (t.name(i) in _MODIFIERS or t.is_(i, "*") or t.name(i) in ("get", "set")) and not t.is_(i + 1, "(", "=", ";", ":", "<", "?", "!"):
                prefix = f"{t[i].text}_" if t.name(i) in ("get", "set") else prefix
                i += 1
            if t.is_(i, "{"):  # static block
                self._scan(i + 1, t.partner[i], owner, depth)
                i = t.after(i)
                continue
            named = i < end and (t[i].kind in ("name", "string", "number") or t.is_(i, "["))
            name = t.slice(i, min(t.after(i), end)).strip("\"'") if named else None
            at = t.after(i) if t.is_(i, "[") else i + 1
            at += t.is_(at, "?", "!")
            params = t.angled(at) if t.is_(at, "<") else at
            if name and t.is_(params, "("):
                body = self._body(params, end)
                if body is None:  # abstract, or an overload
                    i = self._past_type(t.after(params), end, ";", "}") if t.is_(t.after(params), ":") else t.after(params)
                    continue
                last = min(t.partner[body], len(t) - 1)
                self._callable("Method", prefix + name, first, params, body + 1, last, owner, depth, "Public", self._signature(params))
                i = last + 1
                continue
            i = max(i + 1, self._past_type(at, end, "=", ";") if t.is_(at, ":") and self._typed_field(at, end) else at)
            if t.is_(i, "="):
                stop = self._end_of_value(i + 1, end)
                self._scan(i + 1, stop, owner, depth)
                i = stop
        return

    def _typed_field(self, at: int, end: int) -> bool:
        """Whether the annotation at `at` ends with a value or a semicolon on the same line; else it ends with the line."""
        t, j = self.t, at
        while j < end and t.line(j) == t.line(at):
            if t.is_(j, "=", ";"):
                return True
            j = t.after(j) if t.is_(j, *OPEN) else j + 1
        return False

    # modules

    def _pairs(self, i: int, joint: str) -> list[tuple[str, str]]:
        """(wanted, own) names in the curly brackets at i; joint stands between them, as `as` or a colon."""
        t, out, j, close = self.t, [], i + 1, self.t.partner.get(i, i)
        while j < close:
            if t.is_(j, "type") and t.name(j + 1) and not t.is_(j + 1, joint):
                j += 1
            if (wanted := t.name(j)) and not t.is_(j - 1, "..."):
                own = t.name(j + 2) if t.is_(j + 1, joint) else wanted
                if own:
                    out.append((wanted, own))
            while j < close and not t.is_(j, ","):
                j = t.after(j) if t.is_(j, *OPEN) else j + 1
            j += 1
        return out

    def _source(self, i: int, end: int) -> tuple[str | None, int]:
        """The literal behind the next `from` of the statement, and the token behind it."""
        t, j = self.t, i
        while j < end and not t.is_(j, ";"):
            if t.is_(j, "from") and j + 1 < end and t[j + 1].kind == "string":
                return t[j + 1].text[1:-1], j + 2
            if j > i and t.line(j) > t.line(j - 1) and t.name(j) in _STARTS:
                break
            j = t.after(j) if t.is_(j, "{") else j + 1
        return None, j

    def _import(self, i: int, end: int) -> int:
        t = self.t
        if i + 1 < end and t[i + 1].kind == "string":  # for its effects only
            return i + 2
        source, stop = self._source(i, end)
        place = t.place(i, stop - 1)
        marks = ["import", *_from(source)]
        j = i + 1 + (t.is_(i + 1, "type") and (t.is_(i + 2, "{", "*") or t.name(i + 2) not in (None, "from")))
        while j < stop and not t.is_(j, "from"):
            if t.is_(j, "{"):
                for wanted, own in self._pairs(j, "as"):
                    self.imported("Module", own, place, "Private", [*marks, *_original(wanted, own)], infix=("import",))
                j = t.after(j)
            elif t.is_(j, "*") and t.is_(j + 1, "as") and t.name(j + 2):
                self.imported("Module", t_text(t, j + 2), place, "Private", marks, infix=("import",))
                j += 3
            else:
                if t.name(j):
                    self.imported("Module", t_text(t, j), place, "Private", marks, infix=("import",))
                j += 1
        return stop

    def _export(self, i: int) -> int:
        """The token to go on at; lists and re-exports are handled, a declaration follows otherwise."""
        t, end = self.t, len(self.t)
        j = i + 1 + (t.is_(i + 1, "type") and t.is_(i + 2, "{", "*"))
        if t.is_(j, "{"):
            close = t.after(j)
            if t.is_(close, "from") and close + 1 < end and t[close + 1].kind == "string":
                source, place = t[close + 1].text[1:-1], t.place(i, close + 1)
                for wanted, own in self._pairs(j, "as"):
                    self.imported("Module", own, place, "Public", ["import", *_from(source), *_original(wanted, own)], infix=("import",))
                return close + 2
            self.exported_names += [wanted for wanted, _ in self._pairs(j, "as")]
            return close
        if t.is_(j, "*"):
            source, stop = self._source(j, end)
            name = t.name(j + 2) if t.is_(j + 1, "as") else f"*:{source}"
            if source and name:
                star = name.startswith("*:")
                self.imported("Module", name, t.place(i, stop - 1), "Public", ["import", *_from(source)], info="star import" if star else "import", infix=("import",))
            return stop
        return j + 1 if t.is_(j, "default") else j

    # TypeScript

    def _at_line(self, i: int, kind: str, name: str, shown: bool, annotations: list[str]) -> None:
        line = self.t.line(i)
        self.symbol(kind, name, {"line": line, "column": 1, "end_line": line, "end_column": 1}, "Public" if shown else "Private", None, annotations)

    def _type_only(self, i: int, end: int, shown: bool) -> int | None:
        """An interface, an enum or a type alias; its body holds nothing to read."""
        t, word, name = self.t, self.t[i].text, t_text(self.t, i + 1)
        if word == "type":
            j = t.angled(i + 2) if t.is_(i + 2, "<") else i + 2
            if not t.is_(j, "="):
                return None
            self._at_line(i, "Interface", name, shown, ["type_alias"])
            while j < end and not t.is_(j, ";") and not (t.line(j) > t.line(j - 1) and t.name(j) in _STARTS and not t.is_(j - 1, "=", "|", "&")):
                j = t.after(j) if t.is_(j, *OPEN) else j + 1
            return j
        j = i + 2
        while j < end and not t.is_(j, "{", ";"):
            j += 1
        if not t.is_(j, "{"):
            return None
        self._at_line(i, "Interface" if word == "interface" else "Enum", name, shown, [])
        return t.after(j)


def t_text(t: Tokens, i: int) -> str:
    return t[i].text


def _from(source: str | None) -> list[str]:
    return [f"from:{source}"] if source else []


def _original(wanted: str, own: str) -> list[str]:
    return [f"original_name:{wanted}"] if wanted != own else []


def read_script(file: str, language: str, text: str) -> list[dict]:
    """Rows of one file; broken text gives what can be read of it."""
    return ScriptReader(file, text, language == "typescript").done()


def parse_scripts(files: DataFrame) -> DataFrame:
    """Rows of all JavaScript and TypeScript files."""
    return parse_with(files, LANGUAGES, read_script)
