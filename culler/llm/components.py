"""Connected components of a graph given as a table of edges.

Each round hooks every vertex to its smallest neighbour or itself, follows these parents to their roots by pointer
doubling, replaces vertices by roots in the edges and drops the loops. Every vertex with an edge
joins another, so vertices at least halve per round, and chains collapse in a logarithmic number of doublings.
The smallest vertex of a component is always a root, so the last root is the component's smallest id.

Scale: minima are partial aggregates, so a hub costs one row per task; the joins on a hub's id read
plain tables on both sides, which adaptive execution splits. Each step is a table in the shared
folder, with a file for about ``ROWS_PER_FILE`` rows; the driver sees only how many rows a table of edges has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from culler.llm.common import written

#: A round's tables are written by one task for so many rows, not by one for each shuffle partition: on a local file system
#: every file that a task creates starts processes of its own, each of which shows the executor's memory until it runs its program.
ROWS_PER_FILE = 100_000


def _table(df: DataFrame, tag: str, most: int) -> DataFrame:
    """``df``, of at most ``most`` rows, as a table."""
    return written(df.coalesce(most // ROWS_PER_FILE + 1), tag)


def with_vertex(classes: DataFrame, *content: str) -> DataFrame:
    """``classes`` (named: a class's smallest id) with ``rep``, its vertex: that id, or a negative number made of the columns
    ``content``, which tell the classes apart, where several classes share the id."""
    shared = written(classes.groupBy("named").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("named").alias("__shared")), "shared-ids")
    of_content = F.xxhash64(*content).bitwiseOR(F.lit(-(1 << 63)))
    rep = F.when(F.col("__shared").isNull(), F.col("named")).otherwise(of_content)
    return classes.join(shared, F.col("named") == F.col("__shared"), "left").withColumn("rep", rep).drop("__shared")


def with_component(classes: DataFrame) -> DataFrame:
    """``classes`` (named, vertex: the smallest vertex of the component) with ``component``, the smallest id there."""
    # a table: as a rule it has no rows, and then the classes of a large component aren't brought together on their vertex
    renamed = written(classes.filter("vertex < 0").groupBy(F.col("vertex").alias("__v")).agg(F.min("named").alias("__name")), "component-names")
    return classes.join(renamed, F.col("vertex") == F.col("__v"), "left").withColumn("component", F.coalesce("__name", "vertex")).drop("__name", "__v")


def _roots(edges: DataFrame, most: int) -> DataFrame:
    """(v, p): every vertex, of at most ``most``, and the root that it reaches through smallest neighbours."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    parents = _table(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p")), "parents", most)
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("q"))
        parents = _table(parents.join(up, "p").select("v", F.col("q").alias("p"), (F.col("q") < F.col("p")).alias("moved")), "parents", most)
        moved = not parents.filter("moved").isEmpty()
        parents = parents.select("v", "p")
        if not moved:
            return parents


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``edges``: a, b (long), at most ``most`` rows where that is known. Returns id, component for every vertex of an edge
    between two vertices; loops and null ends are ignored, repeated edges count once."""
    edges = edges.select("a", "b").filter(F.col("a") != F.col("b"))
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "edges") if most is None else _table(edges, "edges", most)
    n = edges.count()
    vertices, found = 2 * n, None
    while found is None or n:
        roots = _roots(edges, 2 * n)
        if found is None:
            found = roots.select(F.col("v").alias("id"), F.col("p").alias("component"))
        else:
            found = _table(found, "components", vertices).join(roots, F.col("component") == F.col("v"), "left").select(
                "id", F.coalesce("p", "component").alias("component"))
        left = edges.join(roots, F.col("a") == F.col("v")).select(F.col("p").alias("a"), "b")
        both = left.join(roots, F.col("b") == F.col("v")).select("a", F.col("p").alias("b")).filter(F.col("a") != F.col("b"))
        edges = _table(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", n)
        n = edges.count()
    return _table(found, "components", vertices)
