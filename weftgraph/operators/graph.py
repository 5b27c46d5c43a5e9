"""The code graph as four DataFrames, with its lookups, traversals and whole-graph algorithms."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schemas
from weftgraph.operators.components import star_components
from weftgraph.runtime import ship_package


def edge_kind(kind: Column) -> Column:
    """Calls for a call, References for every other reference kind."""
    return F.when(kind == "Call", "Calls").otherwise("References")


@dataclass(frozen=True)
class CodeGraph:
    """Frames are immutable: every change gives a new graph. Null ends of refs stand for what was not resolved."""

    symbols: DataFrame
    refs: DataFrame
    scopes: DataFrame
    boundaries: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> CodeGraph:
        return cls(*(spark.createDataFrame([], s) for s in (schemas.SYMBOLS, schemas.REFS, schemas.SCOPES, schemas.BOUNDARIES)))

    @classmethod
    def of(cls, symbols: DataFrame, refs: DataFrame) -> CodeGraph:
        """A graph without scopes and boundaries."""
        spark = symbols.sparkSession
        return cls(symbols, refs, spark.createDataFrame([], schemas.SCOPES), spark.createDataFrame([], schemas.BOUNDARIES))

    # rows in and out
    def add_symbols(self, rows: DataFrame) -> CodeGraph:
        return replace(self, symbols=self.symbols.unionByName(rows, allowMissingColumns=True))

    def add_scopes(self, rows: DataFrame) -> CodeGraph:
        return replace(self, scopes=self.scopes.unionByName(rows, allowMissingColumns=True))

    def add_refs(self, rows: DataFrame) -> CodeGraph:
        """The edge kind follows from the reference kind."""
        return replace(self, refs=self.refs.unionByName(rows.withColumn("edge_kind", edge_kind(F.col("kind"))), allowMissingColumns=True))

    def add_boundaries(self, rows: DataFrame) -> CodeGraph:
        return replace(self, boundaries=self.boundaries.unionByName(rows, allowMissingColumns=True))

    def update_symbols(self, rows: DataFrame) -> CodeGraph:
        """Rows replace the symbols of the same ids."""
        kept = self.symbols.join(rows.select("id"), "id", "left_anti")
        return replace(self, symbols=kept.unionByName(rows))

    def remove_symbols(self, ids: DataFrame) -> CodeGraph:
        """Drop the symbols of column `id` and the ends that refs have there; ref rows stay, without a usable edge."""
        gone = ids.select(F.col("id").alias("_gone")).distinct()
        refs = self.refs
        for end in ("src", "dst"):
            marked = refs.join(gone, F.col(end) == F.col("_gone"), "left")
            refs = marked.withColumn(end, F.when(F.col("_gone").isNull(), F.col(end))).drop("_gone")
        return replace(self, symbols=self.symbols.join(gone, F.col("id") == F.col("_gone"), "left_anti"), refs=refs)

    def symbol(self, id_: str) -> DataFrame:
        return self.symbols.filter(F.col("id") == id_)

    def scope(self, id_: str) -> DataFrame:
        return self.scopes.filter(F.col("id") == id_)

    def reference(self, id_: str) -> DataFrame:
        return self.refs.filter(F.col("id") == id_)

    def all_symbols(self) -> DataFrame:
        return self.symbols.orderBy("ord", "file", "line", "column", "id")

    def counts(self) -> DataFrame:
        """One row: symbols, scopes and references."""
        one = [f.agg(F.count("*").alias(n)) for f, n in ((self.symbols, "symbols"), (self.scopes, "scopes"), (self.refs, "refs"))]
        return one[0].crossJoin(one[1]).crossJoin(one[2])  # single rows

    def scope_children(self, id_: str) -> DataFrame:
        return self.scopes.filter(F.col("parent_id") == id_)

    def symbols_in_scope(self, id_: str) -> DataFrame:
        return self.symbols.filter(F.col("scope_id") == id_)

    def symbols_in_file(self, file: str) -> DataFrame:
        return self.symbols.filter(F.col("file") == file)

    def references_from_file(self, file: str) -> DataFrame:
        inside = self.symbols_in_file(file).select(F.col("id").alias("_in"))
        return self.refs.join(inside, F.col("src") == F.col("_in"), "left_semi")

    # edges
    def edges(self) -> DataFrame:
        """(src, dst, edge_kind, ref_id, kind): refs with both ends; parallel edges stay."""
        r = self.refs.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
        return r.select("src", "dst", "edge_kind", F.col("id").alias("ref_id"), "kind")

    def calls(self) -> DataFrame:
        return self.edges().filter("edge_kind = 'Calls'")

    def callees(self, id_: str | None = None) -> DataFrame:
        """(src, dst) call pairs as a bag, of one caller if given."""
        e = self.calls().select("src", "dst")
        return e if id_ is None else e.filter(F.col("src") == id_)

    def callers(self, id_: str | None = None) -> DataFrame:
        e = self.calls().select("dst", "src")
        return e if id_ is None else e.filter(F.col("dst") == id_)

    def importers(self, id_: str | None = None) -> DataFrame:
        """(dst, src) of References edges of any reference kind."""
        e = self.edges().filter("edge_kind = 'References'").select("dst", "src")
        return e if id_ is None else e.filter(F.col("dst") == id_)

    def edges_from(self, id_: str) -> DataFrame:
        return self.edges().filter(F.col("src") == id_)

    def edges_to(self, id_: str) -> DataFrame:
        return self.edges().filter(F.col("dst") == id_)

    def in_degree(self) -> DataFrame:
        """(id, in_degree) of every symbol."""
        n = self.edges().groupBy("dst").agg(F.count("*").alias("in_degree"))
        return self.symbols.select("id").join(n, F.col("id") == F.col("dst"), "left").select("id", F.coalesce("in_degree", F.lit(0).cast("long")).alias("in_degree"))

    # whole-graph algorithms
    def components(self) -> DataFrame:
        """(id, component) of every symbol; the component is its least id. Edges count without direction."""
        known = self.edges()
        comps = star_components(known)
        out = self.symbols.select("id").join(comps, F.col("id") == F.col("node"), "left")
        return out.select("id", F.coalesce("component", "id").alias("component"))

    def cycles(self) -> DataFrame:
        """(component, cycle array<string>): one cycle for each back edge of a depth-first search from symbols in order.

        Not all elementary cycles. Each weakly connected component is searched as one group.
        """
        ship_package(self.symbols.sparkSession)
        order = self.symbols.select(F.col("id").alias("src"), F.col("ord").alias("o"))
        edges = self.edges().select("src", "dst").distinct().join(order, "src")
        return back_edge_cycles(edges)


def back_edge_cycles(edges: DataFrame, least: int = 1) -> DataFrame:
    """(component, cycle) by depth-first search over edges (src, dst, o), roots and neighbours in order of (o, name)."""
    comps = star_components(edges)
    tagged = edges.join(comps, F.col("src") == F.col("node"), "left").select(F.coalesce("component", "src").alias("component"), "src", "dst", "o")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        place = dict(zip(pdf["src"], pdf["o"], strict=True))
        key = lambda v: (place.get(v, float("inf")), v)
        near: dict[str, list[str]] = {}
        for s, d in zip(pdf["src"], pdf["dst"], strict=True):
            near.setdefault(s, []).append(d)
        near = {k: sorted(set(v), key=key) for k, v in near.items()}
        state: dict[str, int] = {}
        out = []
        for root in sorted(near, key=key):
            if root in state:
                continue
            path, at, walk = [root], {root: 0}, [iter(near[root])]
            state[root] = 1
            while walk:
                nxt = next(walk[-1], None)
                if nxt is None:
                    walk.pop()
                    done = path.pop()
                    del at[done]
                    state[done] = 2
                elif state.get(nxt) == 1:
                    if len(path) - at[nxt] >= least:
                        out.append(path[at[nxt] :])
                elif nxt not in state:
                    state[nxt] = 1
                    at[nxt] = len(path)
                    path.append(nxt)
                    walk.append(iter(near.get(nxt, ())))
        return pd.DataFrame({"component": pd.Series([pdf["component"].iloc[0]] * len(out), dtype=object), "cycle": pd.Series(out, dtype=object)})

    return tagged.groupBy("component").applyInPandas(search, "component string, cycle array<string>")


def canonical(cycle: Column) -> Column:
    """The cycle turned so that its least member stands first."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, at, F.size(cycle) - at + 1), F.slice(cycle, 1, at - 1))
