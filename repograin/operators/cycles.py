"""Cycles of any length in a directed graph: strongly connected components, and a shortest witness in each.

Every step is a join of narrow edge and label tables and a minimum by node,
which is combined before the shuffle; so a node with very many edges spreads
over tasks, and all keys (repositories) run at the same time. Labels move
``STEPS`` edges between two saved tables, and the number of saved tables grows
with the longest way inside the graph, not with its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.registry import operator
from repograin.session import saved

STEPS = 8  # edges that labels cross between two saved tables


def _trimmed(links: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that start where one arrives and end where one starts, twice over: the rest is on no cycle."""
    for _ in range(2):
        arrives = links.select(*keys, F.col("dst").alias("src")).distinct()
        starts = links.select(*keys, F.col("src").alias("dst")).distinct()
        links = links.join(arrives, [*keys, "src"], "left_semi").join(starts, [*keys, "dst"], "left_semi")
    return saved(links.select(*keys, "src", "dst"), "links")


def _with_stays(links: DataFrame, keys: list[str]) -> DataFrame:
    """The edges, and for every node one to itself (``far`` 0), so that a step keeps what a node has."""
    ends = links.select(*keys, F.col("src").alias("node")).unionByName(links.select(*keys, F.col("dst").alias("node"))).distinct()
    stays = ends.select(*keys, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("far"))
    return saved(links.select(*keys, "src", "dst", F.lit(1).alias("far")).unionByName(stays), "steps")


def _colors(steps: DataFrame, keys: list[str]) -> DataFrame:
    """``node, color``: the least node from which a node can be reached, itself included."""
    colors = steps.where("far = 0").select(*keys, F.col("src").alias("node"), F.col("src").alias("color"))
    while True:
        later = colors
        for _ in range(STEPS):
            later = steps.join(later.withColumnRenamed("node", "src"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.min("color").alias("color"))
        later = saved(later, "colors")
        if later.join(colors, [*keys, "node", "color"], "left_anti").isEmpty():
            return later
        colors = later


def _reaching(steps: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes from which a root can be reached inside ``steps``."""
    marked, known = roots, -1
    while True:
        for _ in range(STEPS):
            marked = steps.join(marked.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_semi").select(*keys, F.col("src").alias("node")).distinct()
        marked = saved(marked, "marked")
        n = marked.count()
        if n == known:
            return marked
        known = n


@operator("cycles.components")
def components(edge: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, component`` of all strongly connected components of two nodes or more, named by their least node.

    Each round colors nodes by the least node that reaches them; where a node
    has its own name as color, the nodes of that color that reach it are its
    component. Edges between colors, and of found nodes, go; the rest is colored
    again. Edges may repeat; one from a node to itself joins nothing.
    """
    links = saved(edge.select(*keys, "src", "dst").where("src <> dst").distinct(), "links")
    found = None
    while True:
        links = _trimmed(links, keys)
        if links.isEmpty():
            break
        colors = _colors(_with_stays(links, keys), keys)
        of = lambda end: colors.select(*keys, F.col("node").alias(end), F.col("color").alias(f"{end}_color"))
        inside = saved(links.join(of("src"), [*keys, "src"]).join(of("dst"), [*keys, "dst"]).where("src_color = dst_color").select(*keys, "src", "dst"), "inside")
        if inside.isEmpty():
            break
        roots = colors.where("node = color").select(*keys, "node")
        marked = _reaching(_with_stays(inside, keys), roots, keys)
        here = saved(marked.join(colors, [*keys, "node"]).select(*keys, "node", F.col("color").alias("component")), "components")
        found = here if found is None else found.unionByName(here)
        gone = here.select(*keys, "node")
        links = inside.join(gone.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_anti")
    if found is None:
        return edge.limit(0).select(*keys, F.col("src").alias("node"), F.col("src").alias("component"))
    several = found.groupBy(*keys, "component").agg(F.count("*").alias("n")).where("n > 1").select(*keys, "component")
    return found.join(several, [*keys, "component"], "left_semi").select(*keys, "node", "component")


def _levels(steps: DataFrame, keys: list[str]) -> DataFrame:
    """``node, level, parent``: edges from the component's name to a node, and the least node before it on a shortest way."""
    start = F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent"))
    levels = steps.where("far = 0 AND src = component").select(*keys, F.col("src").alias("node"), start.alias("way"))
    step = F.when(F.col("far") == 0, F.col("way")).otherwise(F.struct((F.col("way.level") + 1).alias("level"), F.col("src").alias("parent")))
    while True:
        later = levels
        for _ in range(STEPS):
            later = steps.join(later.withColumnRenamed("node", "src"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.min(step).alias("way"))
        later = saved(later, "levels")
        plain = lambda df: df.select(*keys, "node", "way.level")
        if plain(later).join(plain(levels), [*keys, "node", "level"], "left_anti").isEmpty():
            return later.select(*keys, "node", "way.level", "way.parent")
        levels = later


def _ancestors(closing: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """All nodes on the ways back from ``closing``, by jumps that double."""
    on_way = closing.select(*keys, "node")
    jumps = saved(levels.where("parent IS NOT NULL").select(*keys, "node", F.col("parent").alias("back")), "jumps")
    while not jumps.isEmpty():
        before = on_way.join(jumps, [*keys, "node"]).select(*keys, F.col("back").alias("node"))
        on_way = saved(on_way.unionByName(before).distinct(), "on-way")
        jumps = saved(jumps.join(jumps.select(*keys, F.col("node").alias("back"), F.col("back").alias("further")), [*keys, "back"]).select(*keys, "node", F.col("further").alias("back")), "jumps")
    return on_way


@operator("cycles.witnesses")
def witnesses(edge: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, component, modules, length, cycle``: one row per component with a shortest cycle through its least node.

    Of shortest cycles the one whose nodes, looked at from its end, come first
    by name. A node with an edge to itself is a row of its own, of length one.
    """
    of = saved(components(edge, keys), "of")
    sizes = of.groupBy(*keys, "component").agg(F.count("*").alias("modules"))
    ends = lambda end: of.select(*keys, F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    links = edge.select(*keys, "src", "dst").where("src <> dst").distinct().join(ends("src"), [*keys, "src"]).join(ends("dst"), [*keys, "dst"])
    links = saved(links.where("src_component = dst_component").select(*keys, F.col("src_component").alias("component"), "src", "dst"), "inside")
    loops = edge.where("src = dst").select(*keys, "src").distinct().select(*keys, F.col("src").alias("component"), F.lit(1).cast("long").alias("modules"), F.lit(1).alias("length"), F.col("src").alias("cycle"))
    if links.isEmpty():
        return loops
    both = [*keys, "component"]
    levels = _levels(_with_stays(links, both), both)
    back = links.where("dst = component").select(*both, F.col("src").alias("node")).join(levels, [*both, "node"])
    closing = saved(back.groupBy(*both).agg(F.min(F.struct("level", "node")).alias("end")).select(*both, "end.node", (F.col("end.level") + 1).alias("length")), "closing")
    on_way = _ancestors(closing, levels, both).join(levels, [*both, "node"])
    ways = on_way.groupBy(*both).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "node"))), lambda s: s["node"]), ">").alias("cycle"))
    return ways.join(closing.select(*both, "length"), both).join(sizes, both).select(*keys, "component", "modules", "length", "cycle").unionByName(loops)
