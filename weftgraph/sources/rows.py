"""What every front-end gives: rows of symbols, scopes and references of one file, in one table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import ship_package
from weftgraph.schemas import LAST_LINE, PLACE

#: One table for all row kinds: `symbol`, `scope` and `ref`.
ROWS = (
    "row_kind string, id string, kind string, name string, qualified_name string, visibility string, signature string, "
    f"{PLACE}, resolution string, resolution_info string, scope_id string, annotations array<string>, ord bigint, src string, parent_id string, tag string, arg string, class_scope string"
)
#: Nesting that the front-ends follow.
DEPTH = 256


class Collector:
    """Collects the rows of one file; the stack holds (kind, id, name) of the open scopes."""

    def __init__(self, file: str, place: dict):
        self.file, self.rows, self.n = file, [], 0
        self.module_id, self.module_used = self._id("Module", "<module>", 1, 1), False
        self.stack: list[tuple[str, str, str]] = []
        self.open("File", file, place)

    def _id(self, *parts) -> str:
        return hashlib.blake2b("|".join(map(str, (self.file, *parts, self.n))).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()

    def _row(self, row_kind: str, **values) -> dict:
        self.n += 1
        self.rows.append({"row_kind": row_kind, "file": self.file, "ord": self.n, **values})
        return self.rows[-1]

    def open(self, kind: str, name: str, place: dict) -> None:
        """Open a scope; close() ends it."""
        id_ = self._id("scope", kind, name)
        self._row("scope", id=id_, kind=kind, name=name, parent_id=self.stack[-1][1] if self.stack else None, **place)
        self.stack.append((kind, id_, name))

    def close(self) -> None:
        self.stack.pop()

    def symbol(self, kind: str, name: str, place: dict, visibility: str = "Public", signature: str | None = None, annotations=(), resolution: str = "Resolved", info: str | None = None, infix: tuple[str, ...] = ()) -> str:
        id_ = self._id(kind, name, place["line"], place["column"])
        path = "::".join([*(s[2] for s in self.stack), *infix, name])
        self._row("symbol", id=id_, kind=kind, name=name, qualified_name=path, visibility=visibility, signature=signature, scope_id=self.stack[-1][1], annotations=list(annotations), resolution=resolution, resolution_info=info, **place)
        return id_

    def imported(self, kind: str, name: str, place: dict, visibility: str, annotations: list[str], resolution: str = "Partial", info: str | None = "import", infix: tuple[str, ...] = ()) -> str:
        """A symbol for an import, and the reference that stands for the statement."""
        self._row("ref", id=self._id("ref", "import", name), kind="Import", tag="import", arg=name, **place)
        return self.symbol(kind, name, place, visibility, None, annotations, resolution, info, infix)

    def ref(self, tag: str, arg: str, place: dict, owner: str | None) -> None:
        """A call or another use by the callable `owner`, or by the module itself."""
        self.module_used |= owner is None
        enclosing = next((s[1] for s in reversed(self.stack) if s[0] == "Module"), None)
        self._row("ref", id=self._id("ref", tag, arg), kind="Call" if tag == "call" else "Read", src=owner or self.module_id, tag=tag, arg=arg, class_scope=enclosing, **place)

    def done(self) -> list[dict]:
        """All rows: with the module's own symbol if something outside callables uses names, and with the file's first symbol as the source of imports."""
        if self.module_used:
            self._row("symbol", id=self.module_id, kind="Module", name="<module>", qualified_name=f"{self.file}::<module>", visibility="Public", line=1, column=1, end_line=LAST_LINE, end_column=1, resolution="Resolved", annotations=[])
        first = next((r["id"] for r in self.rows if r["row_kind"] == "symbol"), None)
        for r in self.rows:
            if r["row_kind"] == "ref" and "src" not in r:
                r["src"] = first
        return self.rows


def parse_with(files: DataFrame, languages: tuple[str, ...], read: Callable[[str, str, str], list[dict]]) -> DataFrame:
    """ROWS of all files (rel_path, language, content) in the given languages. One file never fails the others: what it cannot read gives no rows."""
    ship_package(files.sparkSession)
    texts, longs = pa.string(), pa.int64()
    kinds = {"bigint": longs, "array<string>": pa.list_(texts)}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[1], texts)) for c in ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = read(file, language, text)
                except (RecursionError, MemoryError):
                    continue
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.filter(F.col("language").isin(*languages)).select("rel_path", "language", "content").mapInArrow(run, ROWS)
