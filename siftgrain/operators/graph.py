"""Graphs of repositories and files: provider resolution, traversal, impact, components and waves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgrain.session import cut_lineage

#: Rounds after which the lineage of an iteration is cut.
CUT_EVERY = 4


#: Limits of a workspace run (fixed values).
WORKSPACE_LIMITS = {"manifest_bytes": 262144, "declarations_per_repository": 2000, "identities_per_repository": 512, "repositories_per_run": 64, "candidates_per_key": 32}


def with_proximity(reached: DataFrame) -> DataFrame:
    """``node, depth, proximity`` of what was reached, the seeds left out: 0.9 next to them, 0.6 one further, 0.3 beyond."""
    return reached.where("depth > 0").select("node", "depth", F.when(F.col("depth") == 1, 0.9).when(F.col("depth") == 2, 0.6).otherwise(0.3).alias("proximity"))


def resolve_providers(declarations: DataFrame, provides: DataFrame) -> DataFrame:
    """``consumer, name, status, provider``: declarations joined to what other repositories provide.

    ``resolved`` with one provider, ``ambiguous`` with several (provider null),
    ``missing`` with none. A repository never provides for itself.
    """
    offers = provides.select(F.col("repository_id").alias("provider"), "name").distinct()
    pairs = declarations.select(F.col("repository_id").alias("consumer"), "name").distinct().join(offers, "name", "left").withColumn("provider", F.when(F.col("provider") != F.col("consumer"), F.col("provider")))
    counted = pairs.groupBy("consumer", "name").agg(F.count("provider").alias("n"), F.min("provider").alias("provider"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return counted.select("consumer", "name", status.alias("status"), F.when(F.col("n") == 1, F.col("provider")).alias("provider"))


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with either end among ``node``: two equi-joins and a distinct, never a join on OR."""
    ends = nodes.select("node").distinct()
    return edges.join(ends, F.col("source") == F.col("node"), "left_semi").union(edges.join(ends, F.col("target") == F.col("node"), "left_semi")).distinct()


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, directed: bool = True, max_nodes: int | None = None) -> DataFrame:
    """``node, depth``: what can be reached from ``seeds`` (``node``) in at most ``max_depth`` hops, each with its least depth.

    A frontier is joined to the edges round by round; visited nodes are left out
    by an anti-join. ``max_nodes`` caps a round's new nodes in their order (a
    budget of the search, not a sample).
    """
    hops = edges.select("source", "target")
    if not directed:
        hops = hops.union(hops.select(F.col("target").alias("source"), F.col("source").alias("target")))
    hops = hops.distinct()
    seen = cut_lineage(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        new = frontier.join(hops, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        if max_nodes is not None:
            new = new.orderBy("node").limit(max_nodes)
        frontier = cut_lineage(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % CUT_EVERY == 0:
            seen = cut_lineage(seen)
    return seen


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``node, depth, path, min_confidence, level`` of each dependent of the seeds, by its first-found shortest path.

    Edges point from consumer (``source``) to provider (``target``) with
    ``edge_id, confidence, resolved``; of equally short paths the one with the
    least edge ids counts, and the level is that path's.
    """
    seen = cut_lineage(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"), F.lit(1.0).alias("min_confidence"), F.lit(True).alias("resolved")))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.alias("f").join(edges.alias("e"), F.col("f.node") == F.col("e.target")).select(
            F.col("e.source").alias("node"), F.lit(depth).alias("depth"), F.concat("f.path", F.array(F.col("e.edge_id").cast("string"))).alias("path"),
            F.least("f.min_confidence", "e.confidence").alias("min_confidence"), (F.col("f.resolved") & F.col("e.resolved")).alias("resolved"),
        )
        best = step.groupBy("node").agg(F.min(F.struct("path", "depth", "min_confidence", "resolved")).alias("b")).select("node", "b.depth", "b.path", "b.min_confidence", "b.resolved")
        frontier = cut_lineage(best.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    level = F.when(~F.col("resolved"), "POSSIBLE_INFERRED").when(F.col("depth") == 1, "DIRECT_RESOLVED").otherwise("INDIRECT_RESOLVED")
    return seen.where("depth > 0").select("node", "depth", "path", "min_confidence", level.alias("level"))


def closure(edges: DataFrame) -> DataFrame:
    """``source, target``: all pairs with a path, by doubling path lengths; for graphs of repositories, whose number is small."""
    pairs = cut_lineage(edges.select("source", "target").distinct())
    n = pairs.count()
    while True:
        more = pairs.alias("a").join(pairs.alias("b"), F.col("a.target") == F.col("b.source")).select(F.col("a.source"), F.col("b.target"))
        pairs = cut_lineage(pairs.union(more).distinct())
        before, n = n, pairs.count()
        if n == before:
            return pairs


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: strongly connected components, named by their least node.

    Nodes without an edge in or out are components of their own and are trimmed
    first. Of the rest every node takes the least name that reaches it, until
    none changes; going back from each name's own node along edges between nodes
    of that name gives its component, which is taken out. No pairs of nodes are
    ever listed: a round joins one name per node to the edges.
    """
    hops = cut_lineage(edges.select("source", "target").where("source <> target").distinct())
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    left, parts = hops, []
    while True:
        while True:  # trim
            inner = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
            inner = cut_lineage(inner)
            same = inner.count() == left.count()
            left = inner
            if same:
                break
        if left.isEmpty():
            break
        name = cut_lineage(left.select(F.col("source").alias("node")).union(left.select("target")).distinct().withColumn("name", F.col("node")))
        while True:  # the least name that reaches each node
            sent = left.join(name, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.min("name").alias("sent"))
            new = cut_lineage(name.join(sent, "node", "left").select("node", F.least("name", F.coalesce("sent", F.col("name"))).alias("name"), (F.coalesce("sent", F.col("name")) < F.col("name")).alias("moved")))
            done = new.where("moved").isEmpty()
            name = new.drop("moved")
            if done:
                break
        of = lambda side: name.select(F.col("node").alias(side), F.col("name").alias(f"{side}_name"))
        within = cut_lineage(left.join(of("source"), "source").join(of("target"), "target").where("source_name = target_name").select("source", "target", F.col("source_name").alias("name")))
        found = cut_lineage(name.where("node = name"))
        while True:  # back from each name's own node
            more = within.join(found.select(F.col("node").alias("target"), "name"), ["target", "name"]).select(F.col("source").alias("node"), "name").distinct().join(found, ["node", "name"], "left_anti")
            more = cut_lineage(more)
            if more.isEmpty():
                break
            found = cut_lineage(found.unionByName(more))
        parts.append(found)
        gone = found.select("node")
        left = cut_lineage(left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"))
    if not parts:
        return nodes.select("node", F.col("node").alias("component"))
    named = reduce(DataFrame.unionByName, parts).select("node", F.col("name").alias("component"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def waves(edges: DataFrame) -> DataFrame:
    """``node, component, wave``: the order in which providers come before consumers; wave 1 depends on nothing outside its component.

    An edge's source depends on its target. A component's wave is one more than
    the longest chain of components it depends on.
    """
    named = cut_lineage(components(edges))
    of = lambda side: named.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component"))
    between = cut_lineage(edges.join(of("source"), "source").join(of("target"), "target").select(F.col("source_component").alias("c"), F.col("target_component").alias("p")).where("c <> p").distinct())
    level = cut_lineage(named.select(F.col("component").alias("c")).distinct().withColumn("wave", F.lit(1)))
    while True:
        raised = between.join(level.select(F.col("c").alias("p"), F.col("wave").alias("below")), "p").groupBy("c").agg((F.max("below") + 1).alias("raised"))
        new = cut_lineage(level.join(raised, "c", "left").select("c", F.greatest("wave", F.coalesce("raised", F.lit(1))).alias("wave")))
        same = new.join(level.withColumnRenamed("wave", "was"), "c").where("wave <> was").isEmpty()
        level = new
        if same:
            return named.join(level, F.col("component") == F.col("c")).select("node", "component", "wave")
