"""Directory maps as long tables: roll-up to every ancestor, pruning, exports, frequency, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import text as T
from codeweft.operators.stats import ancestors


def rolled_up(c: DataFrame) -> DataFrame:
    """path, depth, parent, name and components of every folder (AGG-11, AGG-12): prefixes and one grouping, no recursion."""
    per = c.groupBy("path").agg(F.count("*").alias("n")).select("n", F.explode(ancestors(F.col("path"))).alias("path"))
    g = per.groupBy("path").agg(F.sum("n").cast("bigint").alias("components"), F.count("*").alias("files"))
    depth = F.size(F.split("path", "/"))
    return g.select("path", depth.cast("bigint").alias("depth"), F.when(depth > 1, T.dirname(F.col("path"))).otherwise(F.lit("")).alias("parent"), T.basename(F.col("path")).alias("name"), "components", "files")


def pruned(nodes: DataFrame, depth: int) -> DataFrame:
    """GRF-06: nodes down to a depth; counts stay."""
    return nodes.filter(F.col("depth") <= depth)


def smart_pruned(nodes: DataFrame, depth: int, threshold: int) -> DataFrame:
    """GRF-07: below the second level a folder is opened only if it holds enough components.

    A node is seen where every ancestor from the third level on is open: a join with its ancestors and a bool_and.
    """
    n = nodes.filter(F.col("depth") <= depth)
    up = n.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    open_ = n.select(F.col("path").alias("above"), ((F.col("depth") <= 2) | (F.col("components") >= threshold)).alias("open"))
    seen = up.join(open_, "above").groupBy("path").agg(F.bool_and("open").alias("seen"))
    return n.join(seen, "path", "left").filter(F.coalesce("seen", F.lit(True))).drop("seen")


def exports_per_folder(c: DataFrame, limit: int = 5) -> DataFrame:
    """First exported names of every folder, in index order (WIN-02, PRJ-11)."""
    e = c.filter("exported AND name IS NOT NULL").select(T.dirname(F.col("path")).alias("folder"), "ord", "name", F.coalesce("type", F.lit("unknown")).alias("type"))
    w = Window.partitionBy("folder").orderBy("ord")
    return e.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= limit).select("folder", "rank", "name", "type")


def with_frequency(nodes: DataFrame, frequency: DataFrame) -> DataFrame:
    """JN-06."""
    return nodes.join(frequency, "path", "left").na.fill(0, ["last_30", "last_90"])


def rendered(nodes: DataFrame) -> DataFrame:
    """path, sort and text of the line of every node (GRF-08, SRT-03): children by name below their parent, box connectors.

    A connector depends on whether a node and its ancestors are the last of their parents: a window over the children,
    a join with the ancestors and one aggregation. Ordering by sort gives the whole text.
    """
    w = Window.partitionBy("parent").orderBy(F.desc("name"))
    n = nodes.withColumn("last", F.row_number().over(w) == 1)
    up = n.select("path", "depth", F.explode(ancestors(F.concat_ws("/", "path", F.lit("x")))).alias("above"))
    flags = n.select(F.col("path").alias("above"), F.col("depth").alias("level"), "last")
    line = up.join(flags, "above").filter("level > 1").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("level", "last"))).alias("f"))
    bars = lambda f: F.concat_ws("", F.transform(F.slice(f, 1, F.size(f) - 1), lambda x: F.when(x["last"], "   ").otherwise("│  ")), F.when(F.element_at(f, -1)["last"], "└─ ").otherwise("├─ "))
    count = F.format_number("components", 0)
    text = F.when(F.col("f").isNull(), F.concat("name", F.lit("/  "), count, F.lit(" components"))).otherwise(F.concat(bars(F.col("f")), "name", F.lit("/  "), count))
    return n.join(line, "path", "left").select("path", F.regexp_replace("path", "/", "\x01").alias("sort"), text.alias("text"))


def depth_for_budget(nodes: DataFrame, budget: int, deepest: int = 5) -> DataFrame:
    """depth, tokens and chosen: the estimated tokens of the rendered map at every depth, and the deepest that fits the budget, at least 1 (GRF-09).

    Sums of line lengths and words by depth give all estimates at once; nothing is rendered twice.
    """
    r = rendered(nodes.filter(F.col("depth") <= deepest))
    t = T.collapsed(F.col("text"))
    per = r.select(F.size(F.split("path", "/")).alias("d"), (F.length(t) + 1).alias("chars"), F.size(F.split(t, " ")).alias("words")).groupBy("d").agg(F.sum("chars").alias("chars"), F.sum("words").alias("words"))
    w = Window.orderBy("d")  # one row a depth
    s = per.select(F.col("d").cast("bigint").alias("depth"), F.greatest(F.ceil((F.sum("chars").over(w) - 1) / 4.5), F.ceil(F.sum("words").over(w) * 1.25)).cast("bigint").alias("tokens"))
    fits = F.coalesce(F.max(F.when(F.col("tokens") <= budget, F.col("depth"))).over(Window.partitionBy()), F.lit(1))
    return s.withColumn("chosen", F.col("depth") == fits)
