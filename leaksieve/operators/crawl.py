"""Which URLs a crawl of stored pages reaches, and at what depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.urls import netloc_of
from leaksieve.operators.links import at_depth
from leaksieve.operators.skew import ROWS_PER_TASK, join_hot
from leaksieve.session import ensure_checkpoint_dir


def crawl(
    seeds: DataFrame,
    edges: DataFrame,
    *,
    max_depth: int,
    leaf_files: bool = False,
    same_host: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``(seed, url, depth)``: least number of links from each seed.

    ``seeds`` has a column ``url``; ``edges`` comes from ``page_edges``.  Every
    seed is its own crawl, so the result has a row per seed and page; where that is
    not asked for, ``reach`` walks from all seeds at once.  ``leaf_files`` adds the
    file links of pages at the deepest level, one level deeper.  A page that more
    than ``rows_per_task`` seeds are at is dealt out over several tasks.
    """
    start = seeds.select(F.col("url").alias("seed"), "url")
    return _walk(start, edges, ["seed", "url"], max_depth, leaf_files, same_host, rows_per_task)


def reach(
    seeds: DataFrame, edges: DataFrame, *, max_depth: int, leaf_files: bool = False, same_host: bool = False
) -> DataFrame:
    """``(url, depth)``: least number of links from any seed, one row per URL."""
    return _walk(seeds.select("url"), edges, ["url"], max_depth, leaf_files, same_host, ROWS_PER_TASK)


def _walk(
    start: DataFrame,
    edges: DataFrame,
    state: Sequence[str],
    max_depth: int,
    leaf_files: bool,
    same_host: bool,
    rows_per_task: int,
) -> DataFrame:
    """Breadth first, level by level; ``state`` is what is visited only once.

    The edges are laid out by source once.  Each level is one join, one aggregation
    that folds repeated targets before the shuffle, and one anti-join; it is
    checkpointed, so a lost executor costs one level.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    if same_host:
        edges = edges.where(netloc_of(F.col("src")) == netloc_of(F.col("dst")))
    edges = edges.withColumnRenamed("src", "url").repartition("url").checkpoint()
    frontier = start.distinct().withColumn("depth", F.lit(0)).checkpoint()
    reached = frontier
    for depth in range(max_depth + 1 if leaf_files else max_depth):
        links = at_depth(edges, depth, max_depth).select("url", "dst")
        steps = _followed(frontier.select(*state), links, rows_per_task if "seed" in state else None)
        steps = steps.select(*(F.col("dst").alias("url") if c == "url" else c for c in state)).distinct()
        new = steps.join(reached.select(*state), list(state), "left_anti")
        frontier = new.withColumn("depth", F.lit(depth + 1)).checkpoint()
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def _followed(frontier: DataFrame, links: DataFrame, rows_per_task: int | None) -> DataFrame:
    """The frontier joined with its links; pages that many seeds are at, apart from the rest."""
    if rows_per_task is None:
        return frontier.join(links, "url")
    sizes = frontier.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_task).checkpoint()
    if sizes.isEmpty():
        return frontier.join(links, "url")
    # N rows hold at most N / rows_per_task such pages.
    hubs = F.broadcast(sizes.select("url"))
    rest = frontier.join(hubs, "url", "left_anti").join(links, "url")
    dealt = join_hot(
        frontier.join(hubs, "url", "left_semi"), links.join(hubs, "url", "left_semi"), "url", sizes, rows_per_task
    )
    return rest.unionByName(dealt)
