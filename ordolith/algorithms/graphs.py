"""PageRank, triangles and breadth-first levels over edge frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import stored

DAMPING = 0.85
#: Rounds between tables that cut the lineage.
STORE_EVERY = 4


def page_rank(pages: DataFrame, edges: DataFrame, rounds: int, damping: float = DAMPING) -> DataFrame:
    """(page, rank). Every page keeps its base rank, also without links to it; ranks of pages without links vanish.

    pages: column page; edges: src, dst, parallel ones count. Contributions are summed before the shuffle.
    """
    n = pages.count()
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    ranks = pages.select("page", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        share = ranks.join(degree, ranks["page"] == degree["src"]).select("src", (F.col("rank") / F.col("degree")).alias("share"))
        given = edges.join(share, "src").groupBy("dst").agg(F.sum("share").alias("given"))
        ranks = pages.join(given, pages["page"] == given["dst"], "left").select("page", ((1 - damping) / n + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if i % STORE_EVERY == STORE_EVERY - 1 and i + 1 < rounds:
            ranks = stored(ranks, "ranks")
    return ranks


def page_rank_linked(pages: DataFrame, edges: DataFrame, rounds: int, damping: float = DAMPING) -> DataFrame:
    """The variant that keeps only pages that something links to, from round to round."""
    n = pages.count()
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    ranks = pages.select("page", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        share = ranks.join(degree, ranks["page"] == degree["src"]).select("src", (F.col("rank") / F.col("degree")).alias("share"))
        ranks = edges.join(share, "src").groupBy(F.col("dst").alias("page")).agg(((1 - damping) / n + damping * F.sum("share")).alias("rank"))
        if i % STORE_EVERY == STORE_EVERY - 1 and i + 1 < rounds:
            ranks = stored(ranks, "ranks")
    return ranks


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges a < b without loops."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(triangles): each once. Edges lead from the end of smaller degree, so a hub's pairs aren't all formed."""
    degree = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    da, db = degree.select(F.col("v").alias("a"), F.col("d").alias("da")), degree.select(F.col("v").alias("b"), F.col("d").alias("db"))
    first = F.struct(F.col("da"), F.col("a")) < F.struct(F.col("db"), F.col("b"))
    led = edges.join(da, "a").join(db, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(first, F.col("db")).otherwise(F.col("da")).alias("dv"))
    x, y = led.select("u", F.col("v").alias("v1"), F.col("dv").alias("d1")), led.select("u", F.col("v").alias("v2"), F.col("dv").alias("d2"))
    wedges = x.join(y, "u").where(F.struct("d1", "v1") < F.struct(F.col("d2"), F.col("v2")))
    closing = led.select(F.col("u").alias("v1"), F.col("v").alias("v2"))
    return wedges.join(closing, ["v1", "v2"]).agg(F.count("*").alias("triangles"))


def bfs_levels(edges: DataFrame, source: int, depth: int | None = None) -> DataFrame:
    """(node, level) of all nodes that ``source`` reaches along directed edges, or of those within ``depth`` steps."""
    roots = edges.sparkSession.range(source, source + 1).select(F.col("id").alias("node"), F.lit(0).cast("bigint").alias("level"))
    return spread(roots, stored(edges.select("src", "dst").distinct(), "steps"), depth)


def spread(seen: DataFrame, steps: DataFrame, depth: int | None) -> DataFrame:
    """Levels from the nodes of level 0 on until a round finds nothing new; each round reads and writes tables.

    Only the last round's nodes are followed, and what is known is met once a round.
    """
    front, level = seen.where("level = 0"), 0
    while depth is None or level < depth:
        level += 1
        reached = front.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = stored(reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).cast("bigint").alias("level")), "bfs-front")
        if not front.limit(1).count():
            break
        seen = stored(seen.unionByName(front), "bfs")
    return seen


def bfs_trees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root, level): every node is in a tree. Each further tree grows from the smallest node that none has reached.

    Trees follow one another, as what one reaches is closed to the next: a round of jobs for each level of each tree.
    """
    steps = stored(edges.select("src", "dst").distinct(), "steps")
    left = stored(nodes.select("node").distinct(), "nodes")
    done = None
    while (root := left.agg(F.min("node")).first()[0]) is not None:
        mine = spread(left.where(F.col("node") == root).withColumn("level", F.lit(0).cast("bigint")), steps, None)
        tree = left.join(mine, "node").select("node", F.lit(root).cast("bigint").alias("root"), "level")
        done = stored(tree if done is None else done.unionByName(tree), "trees")
        left = stored(left.join(mine, "node", "left_anti"), "nodes")
        steps = stored(steps.join(left, F.col("dst") == F.col("node"), "left_semi"), "steps")
    return done if done is not None else left.select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("level"))


def bfs_parents(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(node, parent): for each reached node but the source the smallest node one level before that leads to it."""
    a, b = levels.select(F.col("node").alias("src"), F.col("level").alias("l1")), levels.select(F.col("node").alias("dst"), F.col("level").alias("l2"))
    return edges.distinct().join(a, "src").join(b, "dst").where("l1 + 1 = l2").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))


def zipf_graph(spark: SparkSession, pages: int, mean: float = 50.0, spread_by: float = 10.0, exponent: float = 0.9, seed: int = 1) -> DataFrame:
    """(src, dst): a random graph whose out-degrees are normal around ``mean`` and whose targets follow a Zipf law.

    A target's rank is drawn by inverting the law's integral, so no table of weights is built. exponent: below 1.
    """
    degree = F.greatest(F.lit(0), F.round(mean + spread_by * F.randn(seed)).cast("int"))
    src = spark.range(pages).select(F.col("id").alias("src"), degree.alias("degree")).where("degree > 0")
    links = src.select("src", F.explode(F.sequence(F.lit(1), "degree")).alias("_"))
    rank = F.floor(pages * F.pow(F.rand(seed + 1), F.lit(1 / (1 - exponent)))).cast("bigint")
    return links.select("src", F.least(rank, F.lit(pages - 1)).alias("dst"))
