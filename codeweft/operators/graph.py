"""Graph operators over edge tables: dependency edges, PageRank, components, paths, incremental updates."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import cut, forget, staged


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node and component (its least node) of an undirected edge table src, dst (GRF-02).

    Least labels spread along the edges, the label of a node's old label is lowered with it (so whole regions merge in
    a round, not the nodes at their border only), and labels jump to the label of their label. It runs until nothing
    changes: 8 or 9 rounds for shuffled chains of 1000 nodes. Each round is one job of joins and partially aggregated
    minima, which writes its labels, and a look for changed ones. Null ends and loops are dropped, parallel edges count once, nodes (node) adds isolated ones.
    """
    e = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    both = staged(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    labels = staged(both.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("c")), "labels")
    done = False
    while not done:
        near = both.join(labels.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("n"))
        spread = labels.select("node", "c").join(near, "node")
        own = spread.select("node", F.col("c").alias("was"), F.least("c", "n").alias("c"))
        hooked = spread.filter("n < c").groupBy(F.col("c").alias("node")).agg(F.min("n").alias("c")).withColumn("was", F.lit(None).cast(labels.schema["c"].dataType))
        spread = own.unionByName(hooked).groupBy("node").agg(F.max("was").alias("was"), F.min("c").alias("c"))
        target = spread.select(F.col("node").alias("c"), F.col("c").alias("further"))
        new = staged(spread.join(target, "c").select("node", "was", F.least("c", "further").alias("c")), "labels")
        done = new.filter("c <> was").isEmpty()
        forget(labels)
        labels = new
    out = labels.select("node", F.col("c").alias("component"))
    if nodes is not None:
        out = nodes.select("node").filter("node IS NOT NULL").distinct().join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return out


def call_edges(c: DataFrame) -> DataFrame:
    """Calls between components whose file is known: src and dst paths, once per call (JN-01)."""
    return c.select(F.col("path").alias("src"), "repo", F.explode("callees").alias("callee")).filter("callee.file IS NOT NULL").select("src", F.concat_ws("/", "repo", "callee.file").alias("dst"))


def dependency_edges(c: DataFrame) -> DataFrame:
    """Weighted edges between files of the calls whose file is stated (AGG-09)."""
    return weighted(call_edges(c))


def weighted(calls: DataFrame) -> DataFrame:
    """src, dst and weight, the root of the number of calls; no loops (AGG-09)."""
    return calls.filter("src <> dst").groupBy("src", "dst").agg(F.sqrt(F.count("*").cast("double")).alias("weight"))


def graph_nodes(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Sources and targets, each once (SET-02); sources without edges may be added."""
    n = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return (n.union(sources.select("node")) if sources is not None else n).distinct()


def incoming(edges: DataFrame) -> DataFrame:
    """Distinct sources per target (AGG-10)."""
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("incoming"))


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node and rank: weighted PageRank, dangling mass spread evenly (GRF-01).

    A round is one job, a join of ranks and edge shares and one partial sum by target, which writes the new ranks; two
    sums over them, the dangling mass and the change, are all that the driver sees. Tolerance 0 runs all rounds. A node's base row is
    part of the sum, so no second join is needed. An empty graph has no rows.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    nodes = nodes.select("node").distinct()
    share = edges.join(out, "src").select(F.col("src").alias("node"), "dst", (F.col("weight") / F.col("total")).alias("share"))
    linked = share.select("node").distinct().withColumn("linked", F.lit(True))
    nodes = staged(nodes.join(linked, "node", "left").select("node", F.col("linked").isNull().alias("dangling")), "nodes")
    n, dangling = nodes.agg(F.count("*"), F.count_if("dangling")).first()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    # every node sends its flag and nothing to itself, so that it stays in the sum
    share = staged(share.select("node", "dst", "share", F.lit(None).cast("boolean").alias("dangling")).unionByName(nodes.select("node", F.col("node").alias("dst"), F.lit(0.0).alias("share"), "dangling")), "share")
    ranks = nodes.select("node", F.lit(1.0 / n).alias("rank"), "dangling")
    lost = dangling / n
    for _ in range(rounds):
        sent = ranks.select("node", "rank").join(share, "node")
        kept = F.max(F.when(F.col("dangling").isNotNull(), F.col("rank")))
        new = sent.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"), kept.alias("was"), F.max("dangling").alias("dangling"))
        new = new.select("node", ((1 - damping) / n + damping * (F.col("got") + lost / n)).alias("rank"), "dangling", "was")
        before, ranks = ranks, staged(new, "ranks")
        mass, change = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)), F.sum(F.abs(F.col("rank") - F.col("was")))
        lost, moved = ranks.agg(mass, change).first()
        forget(before)
        if tolerance and moved < tolerance:
            break
    return ranks.select("node", "rank")


def hops_from(edges: DataFrame, start: DataFrame, limit: int | None = None) -> DataFrame:
    """node, hops and parent: breadth-first distances from start nodes along the edges (GRF-03).

    Each round joins the frontier with the edges and drops what was seen; the least parent is kept. It
    runs until no node is new, or for limit rounds where one is given. A start that no edge knows reaches itself only.
    """
    e = cut(edges.select("src", "dst").distinct())
    seen = cut(start.select("node").distinct().select("node", F.lit(0).cast("bigint").alias("hops"), F.lit(None).cast("string").alias("parent")))
    frontier = seen
    for k in count(1) if limit is None else range(1, limit + 1):
        step = frontier.select(F.col("node").alias("src")).join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = cut(step.join(seen, "node", "left_anti").select("node", F.lit(k).cast("bigint").alias("hops"), "parent"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def updated_edges(edges: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """The edge table after the sources of changed files are replaced and those of deleted files dropped (GRF-04).

    changed: edges of the changed files; deleted: path. Edges into deleted files stay until the next full build.
    """
    gone = changed.select(F.col("src").alias("path")).unionByName(deleted.select("path")).distinct()
    return edges.join(gone, edges.src == gone.path, "left_anti").unionByName(changed.select(*edges.columns))
