"""Row schemas of the code graph, as DDL, and the ranks of its ordered enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "file string, line bigint, column bigint, end_line bigint, end_column bigint"
FILES = "path string, rel_path string, ext string, language string, content string, n_bytes bigint"
SYMBOLS = (
    "id string, kind string, name string, qualified_name string, visibility string, signature string, "
    f"{PLACE}, resolution string, resolution_info string, scope_id string, annotations array<string>, ord bigint"
)
REFS = f"id string, src string, dst string, kind string, edge_kind string, {PLACE}, resolution string, resolution_info string"
SCOPES = f"id string, kind string, parent_id string, name string, {PLACE}, ord bigint"
BOUNDARIES = "id string, kind string, from_scope string, to_scope string, symbol_id string"
EVIDENCE = "array<struct<observation:string,location:string,context:string>>"
DIAGNOSTICS = f"pattern string, severity string, confidence string, entity string, message string, evidence {EVIDENCE}, suggestion string, loc string, file string, line bigint, column bigint"
FLOW_STEP = "struct<entity:string,action:string,in_type:string,out_type:string>"

SYMBOL_KINDS = ("Function", "Method", "Class", "Struct", "Trait", "Interface", "Module", "Variable", "Constant", "Macro", "Enum")
VISIBILITIES = ("Public", "Private", "Crate", "Protected")
REFERENCE_KINDS = ("Call", "Read", "Write", "Import", "Export", "Implement", "Derive")
EDGE_KINDS = ("Calls", "References", "Contains", "Crosses", "Transforms", "FlowsTo")
SEVERITIES = ("info", "warning", "critical")
CONFIDENCES = ("low", "moderate", "high")
PATTERNS = (
    "isolated_cluster", "data_dead_end", "phantom_dependency", "circular_dependency", "orphaned_impl", "missing_reexport", "layer_violation", "stale_reference", "contract_mismatch",
    "incomplete_migration", "partial_wiring", "duplication", "asymmetric_handling",
)
KIND_LABELS = {
    "Function": "fn", "Method": "method", "Class": "class", "Struct": "struct", "Trait": "trait", "Interface": "interface", "Module": "module", "Variable": "var", "Constant": "const",
    "Macro": "macro", "Enum": "enum",
}
VISIBILITY_LABELS = {"Public": "pub", "Private": "priv", "Crate": "crate", "Protected": "protected"}
#: The last line of a file-wide symbol.
LAST_LINE = 4294967295


def lookup(column: Column, table: dict[str, str]) -> Column:
    """The table's value for a column, null where it has none."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), column)


def rank(column: Column, ordered: tuple[str, ...], unknown: int = 0) -> Column:
    """Place of a value in an ordered enumeration; unknown and null values count as `unknown`."""
    out = F.lit(unknown)
    for i, name in enumerate(ordered):
        out = F.when(column == name, i).otherwise(out)
    return out
