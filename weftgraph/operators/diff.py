"""Differences between two manifests' entities and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ("kind", "vis", "sig", "loc")
SECTIONS = ("entities", "diagnostics")


def entities_added(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.select("id").subtract(old.select("id"))


def entities_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    return entities_added(new, old)


def _last(rows: DataFrame) -> DataFrame:
    """One row for each id; of repeats the last in order of place and fields."""
    order = [F.desc(c) for c in (["ord"] if "ord" in rows.columns else []) + list(reversed(FIELDS))]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("_k = 1").select("id", *FIELDS)


def entities_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, field, old, new) of kind, visibility, signature and place in ids that both have."""
    a, b = _last(old), _last(new).select(F.col("id").alias("_id"), *(F.col(f).alias(f"_{f}") for f in FIELDS))
    met = a.join(b, F.col("id") == F.col("_id"))
    each = F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.struct(F.lit(f).alias("field"), F.col(f).alias("old"), F.col(f"_{f}").alias("new"))) for f in FIELDS))
    return met.select("id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("c")).select("id", "c.field", "c.old", "c.new")


def diagnostics_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings of new whose (pattern, entity, loc) old does not have."""
    keys = ["pattern", "entity", "loc"]
    known = old.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = (F.col("pattern") == F.col("_pattern")) & (F.col("entity") == F.col("_entity")) & (F.col("loc") == F.col("_loc"))
    return new.join(known, same, "left_anti")


def diagnostics_resolved(old: DataFrame, new: DataFrame) -> DataFrame:
    return diagnostics_new(new, old)


def has_regressions(old: DataFrame, new: DataFrame) -> bool:
    """Whether a new critical finding is there."""
    return not diagnostics_new(old, new).filter("severity = 'critical'").isEmpty()


def diff(old: dict[str, DataFrame], new: dict[str, DataFrame], sections: list[str] | None = None) -> dict[str, DataFrame]:
    """entities_added, entities_removed, entities_changed, diagnostics_new and diagnostics_resolved of the chosen sections."""
    chosen = [s for s in sections or [] if s] or list(SECTIONS)
    for s in chosen:
        if s not in SECTIONS:
            raise ValueError(f"unknown section {s!r}; known: {', '.join(SECTIONS)}")
    out = {}
    if "entities" in chosen:
        a, b = old["entities"], new["entities"]
        out |= {"entities_added": entities_added(a, b), "entities_removed": entities_removed(a, b), "entities_changed": entities_changed(a, b)}
    if "diagnostics" in chosen:
        a, b = old["diagnostics"], new["diagnostics"]
        out |= {"diagnostics_new": diagnostics_new(a, b), "diagnostics_resolved": diagnostics_resolved(a, b)}
    return out


def summary_lines(counts: dict[str, int]) -> list[str]:
    """What changed, in words."""
    words = {
        "entities_added": "entities added", "entities_removed": "entities removed", "entities_changed": "entities changed", "diagnostics_new": "new diagnostics", "diagnostics_resolved": "diagnostics resolved"
    }
    return [f"{counts[k]} {text}" for k, text in words.items() if counts.get(k)] or ["no changes"]
