"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import Scratch, release, rows, seen


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node hands its larger (or its other) neighbours to the least node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    met = both.join(least, F.col("u") == F.col("_u"))
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # edges go from the larger node u to smaller ones
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def star_components(edges: DataFrame, src: Column | str = "src", dst: Column | str = "dst", scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node on an edge between two different nodes; component is the least node.

    Edges are undirected; null ends, self-loops and repeats are ignored. Each step is a table of `scratch` in the shared folder, of which only the
    last one is left; the number of steps grows with the logarithm of the longest path. Only the edge count and a digest per step reach the driver.
    """
    own = scratch or Scratch(edges.sparkSession, "components")
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    s, d = (F.col(c) if isinstance(c, str) else c for c in (src, dst))
    e = edges.select(s.alias("a"), d.alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = own.write(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), digest=digest)
    last = None
    while rows(e) and (rows(e), seen(e, "digest")) != last:
        last = (rows(e), seen(e, "digest"))
        old, e = e, own.write(_star(_star(e, large=True), large=False), digest=digest)
        own.drop(old)
        release(e.sparkSession)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    done = own.write(out)
    own.drop(e)
    return done


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node on a cycle; the component is the largest node of its strongly connected component.

    Null ends are ignored; an edge from a node to itself is a cycle. Nodes without a way in or out are trimmed first. Then every node takes the largest
    node that leads to it as its colour; those that lead back to their colour's own node within the colour are one component, and go. Steps are tables in
    the shared folder, as many as the longest of these ways; nothing grows with the pairs of nodes.
    """
    own = Scratch(edges.sparkSession, "strong")
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    loops = own.write(e.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")))
    e, found = own.write(e.filter("src <> dst")), []
    while rows(e):
        e = _trimmed(e, own)
        if not rows(e):
            break
        colors = _coloured(e, own)
        a, b = (colors.select(F.col("node").alias(f"_{k}"), F.col("color").alias(f"_c{k}")) for k in "ab")
        inner = own.write(e.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).filter("_ca = _cb").select("src", "dst", F.col("_ca").alias("color")))
        part = _led_back(inner, own.write(colors.filter("node = color").select("node", "color")), own)
        found.append(part)
        gone = part.select(F.col("node").alias("_g"))
        old, e = e, own.write(e.join(gone, F.col("src") == F.col("_g"), "left_anti").join(gone, F.col("dst") == F.col("_g"), "left_anti"))
        own.drop(old, colors, inner)
        release(e.sparkSession)
    all_found = loops
    for part in found:
        many = part.groupBy("color").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("color").alias("_c"))
        all_found = all_found.unionByName(part.join(many, F.col("color") == F.col("_c"), "left_semi").select("node", F.col("color").alias("component")))
    done = own.write(all_found.groupBy("node").agg(F.max("component").alias("component")))
    own.drop_but(done)
    return done


def _trimmed(e: DataFrame, own: Scratch) -> DataFrame:
    """Edges between nodes that have both a way in and a way out."""
    while True:
        ends, starts = e.select(F.col("dst").alias("_d")).distinct(), e.select(F.col("src").alias("_s")).distinct()
        kept = own.write(e.join(ends, F.col("src") == F.col("_d"), "left_semi").join(starts, F.col("dst") == F.col("_s"), "left_semi"))
        same = rows(kept) == rows(e)
        own.drop(e)
        e = kept
        if same or not rows(e):
            return e


def _coloured(e: DataFrame, own: Scratch) -> DataFrame:
    """(node, color): the largest node from which each node can be reached, itself included."""
    colors = own.write(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("color", F.col("node")))
    while True:
        best = e.join(colors.select(F.col("node").alias("_n"), F.col("color").alias("_c")), F.col("src") == F.col("_n")).groupBy("dst").agg(F.max("_c").alias("_best"))
        grown = colors.join(best, F.col("node") == F.col("dst"), "left").select("node", F.greatest("color", "_best").alias("color"), (F.col("_best") > F.col("color")).alias("more"))
        new = own.write(grown, changed=F.count_if("more"))
        own.drop(colors)
        colors = new
        if not seen(colors, "changed"):
            return colors


def _led_back(inner: DataFrame, roots: DataFrame, own: Scratch) -> DataFrame:
    """(node, color) of the nodes from which their colour's root can be reached within the colour."""
    found = front = roots
    while rows(front):
        met = inner.join(front.select(F.col("node").alias("_n")), F.col("dst") == F.col("_n")).select(F.col("src").alias("node"), "color").distinct()
        front = own.write(met.join(found.select(F.col("node").alias("_k")), F.col("node") == F.col("_k"), "left_anti"))
        found = own.write(found.select("node", "color").unionByName(front))
    return found
