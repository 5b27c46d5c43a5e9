"""Rust text to rows of symbols, scopes and references."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftgraph.sources.rows import DEPTH, Collector, parse_with
from weftgraph.sources.tokens import OPEN, Tokens

LANGUAGES = ("rust",)
#: Type names that are no references.
PRIMITIVES = {"u8", "u16", "u32", "u64", "u128", "usize", "i8", "i16", "i32", "i64", "i128", "isize", "f32", "f64", "bool", "char", "str", "Self", "self"}
_NO_CALL = {"if", "while", "match", "for", "loop", "return", "in", "let", "fn", "as", "move", "unsafe", "where", "impl", "dyn", "mut", "ref", "else", "break", "pub", "crate", "super", "self", "use", "box", "await"}
_ROOTS = {"crate", "self", "super", "Self"}


class RustReader(Collector):
    """Reads one file."""

    def __init__(self, file: str, text: str):
        self.t = Tokens(text, rust=True)
        super().__init__(file, self.t.whole())
        self._scan(0, len(self.t), None, 0, False, False)

    def _scan(self, i: int, end: int, owner: str | None, depth: int, methods: bool, called: bool) -> None:
        """Items, calls and types among the tokens i to end. methods: functions here belong to an impl block; called: inside a call's brackets."""
        t = self.t
        if depth > DEPTH:
            return
        while i < end:
            word, nxt = t.name(i), None
            if t.is_(i, "#") and (t.is_(i + 1, "[") or t.is_(i + 1, "!") and t.is_(i + 2, "[")):  # an attribute
                nxt = t.after(i + 1 + t.is_(i + 1, "!"))
            elif word and t.is_(i + 1, "!") and t.is_(i + 2, *OPEN) and word != "macro_rules":  # what a macro gets is no code yet
                nxt = t.after(i + 2)
            elif word == "macro_rules" and t.is_(i + 1, "!"):
                nxt = t.after(i + 3) if t.is_(i + 3, *OPEN) else i + 2
            elif word == "fn" and t.name(i + 1):
                nxt = self._function(i, end, owner, depth, methods)
            elif word in ("struct", "enum", "trait", "union") and t.name(i + 1) and not t.is_(i - 1, ".", "::"):
                nxt = self._type(i, end, owner, depth)
            elif word == "impl" and not t.is_(i - 1, ":", "->", "(", ",", "<", "&", "=", "+"):
                nxt = self._impl(i, end, owner, depth)
            elif word in ("const", "static") and self._constant(i):
                nxt = i + 2 + t.is_(i + 1, "mut")
            elif word == "mod" and t.name(i + 1) and t.is_(i + 2, "{"):
                last = min(t.partner[i + 2], len(t) - 1)
                self.open("Module", t[i + 1].text, t.place(self._first(i), last))
                self._scan(i + 3, last, owner, depth + 1, False, False)
                self.close()
                nxt = last + 1
            elif word == "use":
                nxt = self._use(i, end)
            elif word:
                nxt = self._word(i, owner, depth, called)
            i = nxt if nxt is not None else i + 1

    # visibility

    def _first(self, i: int) -> int:
        """The first token of the item whose keyword stands at i: what comes before it are modifiers."""
        t = self.t
        while i > 0 and (t.is_(i - 1, "pub", "async", "unsafe", "const", "extern", "default") or t[i - 1].kind == "string" and t.is_(i - 2, "extern") or t.is_(i - 1, ")") and self._restricted(i - 1) is not None):
            i = self._restricted(i - 1) if t.is_(i - 1, ")") else i - 1
        return i

    def _restricted(self, close: int) -> int | None:
        """The `pub` of a bracketed restriction that ends at `close`."""
        for a in range(max(0, close - 12), close):
            if self.t.is_(a, "(") and self.t.partner.get(a) == close:
                return a - 1 if self.t.is_(a - 1, "pub") else None
        return None

    def _visibility(self, i: int) -> str:
        t, a = self.t, self._first(i)
        if not t.is_(a, "pub"):
            return "Private"
        if not t.is_(a + 1, "("):
            return "Public"
        return "Crate" if t.is_(a + 2, "crate") and t.is_(a + 3, ")") else "Protected"

    # items

    def _function(self, i: int, end: int, owner, depth: int, methods: bool) -> int | None:
        t, name = self.t, self.t[i + 1].text
        params = t.angled(i + 2) if t.is_(i + 2, "<") else i + 2
        if not t.is_(params, "("):
            return None
        body = t.after(params)
        while body < end and not t.is_(body, "{", ";"):
            body = t.after(body) if t.is_(body, "(", "[") else body + 1
        first = self._first(i)
        close = t.after(params)
        result = ""
        if t.is_(close, "->"):
            stop = close + 1
            while stop < body and not t.is_(stop, "where"):
                stop += 1
            result = f" -> {t.slice(close + 1, stop)}"
        shown = t.slice(params, close) + result
        if not t.is_(body, "{"):  # a declaration without a body
            return body + 1
        last = min(t.partner[body], len(t) - 1)
        place = t.place(first, last)
        me = self.symbol("Method" if methods else "Function", name, place, self._visibility(i), shown)
        self.open("Function", name, place)
        self._scan(i + 2, body, me, depth + 1, False, False)
        self._scan(body + 1, last, me, depth + 1, False, False)
        self.close()
        return last + 1

    def _type(self, i: int, end: int, owner, depth: int) -> int:
        t, word, name = self.t, self.t[i].text, self.t[i + 1].text
        j = i + 2
        while j < end and not t.is_(j, "{", ";", "("):
            j = max(t.angled(j), j + 1) if t.is_(j, "<") else j + 1
        if t.is_(j, "("):  # fields without names; a semicolon follows
            stop = t.after(j)
            while stop < end and not t.is_(stop, ";"):
                stop += 1
        else:
            stop = min(t.partner.get(j, j), len(t) - 1)
        self.symbol({"struct": "Struct", "union": "Struct", "enum": "Enum", "trait": "Trait"}[word], name, t.place(self._first(i), min(stop, len(t) - 1)), self._visibility(i))
        self._types(i + 2, min(stop, end), owner, self._variants(j) if word == "enum" else set())  # types of fields and methods; methods of a trait are no symbols
        return stop + 1

    def _variants(self, i: int) -> set[int]:
        """The tokens that name the variants of the enum whose bracket opens at i."""
        t, out, close = self.t, set(), self.t.partner.get(i, i)
        i += 1
        while i < close:
            while t.is_(i, "#"):  # attributes
                i = t.after(i + 1)
            out.add(i)
            while i < close and not t.is_(i, ","):
                i = t.after(i) if t.is_(i, *OPEN) else i + 1
            i += 1
        return out

    def _types(self, i: int, end: int, owner, names: set[int] = frozenset()) -> None:
        while i < end:
            if self.t.name(i) and i not in names:
                self._type_name(i, owner, False)
            i += 1

    def _impl(self, i: int, end: int, owner, depth: int) -> int | None:
        t = self.t
        j = t.angled(i + 1) if t.is_(i + 1, "<") else i + 1
        start, body = j, j
        while body < end and not t.is_(body, "{", ";"):
            if t.is_(body, "for") and not t.is_(body + 1, "<"):
                start = body + 1
            body = max(t.angled(body), body + 1) if t.is_(body, "<") else t.after(body) if t.is_(body, "(", "[") else body + 1
        if not t.is_(body, "{"):
            return None
        stop = next((k for k in range(start, body) if t.is_(k, "<", "where")), body)  # generics are left out
        name = t.slice(start, stop).lstrip("&").strip().rsplit("::", 1)[-1]
        last = min(t.partner[body], len(t) - 1)
        self._types(j, body, owner)
        self.open("Module", name, t.place(i, last))
        self._scan(body + 1, last, owner, depth + 1, True, False)
        self.close()
        return last + 1

    def _constant(self, i: int) -> bool:
        t = self.t
        at = i + 1 + t.is_(i + 1, "mut")
        if not (t.name(at) and t.is_(at + 1, ":")):
            return False
        stop = at
        while stop < len(t) and not t.is_(stop, ";"):
            stop = t.after(stop) if t.is_(stop, *OPEN) else stop + 1
        self.symbol("Constant", t[at].text, t.place(self._first(i), min(stop, len(t) - 1)), self._visibility(i))
        return True

    # use trees

    def _use(self, i: int, end: int) -> int:
        stop = i + 1
        while stop < end and not self.t.is_(stop, ";"):
            stop = self.t.after(stop) if self.t.is_(stop, "{") else stop + 1
        self._tree(i + 1, stop, [], self._visibility(i), i)
        return stop + 1

    def _tree(self, i: int, end: int, path: list[str], visibility: str, statement: int) -> None:
        """One branch of a use tree among the tokens i to end, below `path`."""
        t, first, parts = self.t, i, list(path)
        while i < end:
            if t.is_(i, "{"):
                close = min(t.partner[i], end)
                a = i + 1
                while a < close:
                    b = a
                    while b < close and not t.is_(b, ","):
                        b = t.after(b) if t.is_(b, "{") else b + 1
                    self._tree(a, b, parts, visibility, statement)
                    a = b + 1
                return
            if t.is_(i, "*"):  # a reference only, as nothing is named
                self._row("ref", id=self._id("ref", "import", "*"), kind="Import", tag="import", arg="*:" + "::".join(parts), **t.place(statement, end - 1))
                return
            if t.is_(i, "as") and t.name(i + 1):
                self._named(t[i + 1].text, parts[:-1], first, end, visibility)  # under its own name: what it stood for is not kept
                return
            if t.name(i):
                parts.append(t[i].text)
            i += 1
        if parts[len(path) :] == ["self"] and path:  # the module itself
            self._named(path[-1], path, first, end, visibility)
        elif len(parts) > len(path):
            self._named(parts[-1], parts[:-1], first, end, visibility)

    def _named(self, name: str, path: list[str], first: int, end: int, visibility: str) -> None:
        if name == "_":
            return
        marks = ["import", *([f"from:{'::'.join(path)}"] if path else [])]
        self.imported("Variable", name, self.t.place(first, max(first, end - 1)), visibility, marks, "Unresolved", None)

    # uses

    def _word(self, i: int, owner, depth: int, called: bool) -> int | None:
        """A call, a type or a path; the token to go on at if it is not the next one."""
        t, word = self.t, self.t[i].text
        at = i + 1
        if t.is_(at, "::") and t.is_(at + 1, "<"):  # type arguments of a call
            more = t.angled(at + 1)
            at = more if t.is_(more, "(") else at
        if t.is_(at, "(") and word not in _NO_CALL:
            place, close = t.place(self._chain(i), t.partner.get(at, at)), t.partner.get(at, at)
            if t.is_(i - 1, "::"):
                root = self._root(i)
                if root is not None and root not in _ROOTS:
                    self.ref("attribute_access", root, place, owner)
                self.ref("call", word, place, owner)
            elif t.is_(i - 1, "."):
                value = self._value(i)
                if value:
                    self.ref("call", f"{'self' if value == 'Self' else value}.{word}", place, owner)
            else:
                self.ref("call", word, place, owner)
            self._scan(i + 1, at, owner, depth + 1, False, True)
            self._scan(at + 1, close, owner, depth + 1, False, True)
            return close + 1
        self._type_name(i, owner, called)
        return None

    def _type_name(self, i: int, owner, called: bool) -> None:
        """A name that stands for a type begins with a capital and has a small letter or is one letter; a path counts by its first name."""
        t, word = self.t, self.t[i].text
        if word in PRIMITIVES or t.is_(i - 1, "."):
            return
        is_type = word[:1].isupper() and (len(word) == 1 or word.upper() != word)
        if is_type and not t.is_(i + 1, "!"):
            self.ref("attribute_access", word, t.place(i, i), owner)
        if t.is_(i + 1, "::") and not t.is_(i - 1, "::") and not called and word not in _ROOTS and not is_type:
            self.ref("attribute_access", word, t.place(i, i), owner)

    def _chain(self, i: int) -> int:
        """The first token of the path or the chain of fields that ends at i."""
        t = self.t
        while t.is_(i - 1, "::", ".") and t.name(i - 2):
            i -= 2
        return i

    def _root(self, i: int) -> str | None:
        t = self.t
        while t.is_(i - 1, "::"):
            if not t.name(i - 2):
                return None
            i -= 2
        return t[i].text

    def _value(self, i: int) -> str | None:
        """The names before the last point; None if something else than a name is among them."""
        t, parts = self.t, []
        while t.is_(i - 1, "."):
            if not t.name(i - 2):
                return None
            parts.insert(0, t[i - 2].text)
            i -= 2
        return None if t.is_(i - 1, "::") else ".".join(parts)


def read_rust(file: str, language: str, text: str) -> list[dict]:
    """Rows of one file; broken text gives what can be read of it."""
    return RustReader(file, text).done()


def parse_rust(files: DataFrame) -> DataFrame:
    """Rows of all Rust files."""
    return parse_with(files, LANGUAGES, read_rust)
