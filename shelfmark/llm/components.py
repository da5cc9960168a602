"""Connected components by alternating large-star and small-star steps.

Both steps are group minima and joins, so the union-find is spread over the
cluster: no task holds a component, and the driver only reads two sums a round.
A few edges go through several rounds in one task instead, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfmark.llm.storage import BROADCAST_ROWS, remove, stage_at


#: Edges of a node from which on its edges are not shuffled to one task.
HEAVY = 10_000
#: Edges a task writes at least, of tables whose rows were counted to be few.
TASK_EDGES = 50_000
#: Edges that one task takes through TURNS rounds at most.
ONE_TASK, TURNS = 100_000, 4


def _with_least(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """``edges`` joined with the least neighbour of each ``u``; a node of many edges never goes to one task.

    With ``few`` edges the other side is broadcast. Otherwise only the heavy
    nodes are, one for each HEAVY edges at most.
    """
    if few:
        return edges.join(F.broadcast(least.drop("n")), "u")
    heavy = F.broadcast(least.filter(F.col("n") > HEAVY).select("u", F.col("m").alias("heavy")))
    marked = edges.join(heavy, "u", "left")
    light = marked.filter("heavy IS NULL").drop("heavy").join(least.filter(F.col("n") <= HEAVY).drop("n"), "u")
    return light.unionByName(marked.filter("heavy IS NOT NULL").withColumnRenamed("heavy", "m"))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.filter("v > u"), least, few).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame, few: bool, parts: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(down, least, few).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    stars = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(stars.coalesce(parts) if few else stars)


def _turn(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step of edges (u > v) in a single partition, which windows don't shuffle."""
    least = F.min("v").over(Window.partitionBy("u"))
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    large = both.withColumn("m", F.least(least, "u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = large.withColumn("m", least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").filter("u <> v").distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, Observation]:
    """``edges``, and a mark to be had when they are written: equal for equal edge sets, but for a chance of about 2**-64."""
    seen = Observation()
    pair = F.xxhash64("u", "v").cast("decimal(38,0)")
    return edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(pair).alias("sum")), seen


def _mark(seen: Observation) -> tuple:
    return seen.get["n"], seen.get["sum"]


def _staged(edges: DataFrame, purpose: str) -> tuple[DataFrame, str, tuple]:
    """The written edges, where, and their mark."""
    marked, seen = _marked(edges)
    now, path = stage_at(marked, purpose)
    return now, path, _mark(seen)


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``edges`` (u, v long) to (node, component): component is the least node reachable.

    Self loops and repeated edges are allowed; nodes without an edge to another
    node are not returned; null ends are ignored. No edges give no rows. Rounds
    grow with the logarithm of the longest chain.
    """
    now, path, mark = _staged(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct(), purpose)
    while mark[0]:
        if mark[0] <= ONE_TASK:
            after = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(1)
            for _ in range(TURNS - 1):
                after = _turn(after)
            after, seen = _marked(after)
            after, new_path, mark = _staged(_turn(after), purpose)
            remove(now.sparkSession, path)
            now, path = after, new_path
            if mark == _mark(seen):
                break
            continue
        few = mark[0] <= BROADCAST_ROWS // 2  # a node for each end of an edge at most; a step makes no more edges
        parts = mark[0] // TASK_EDGES + 1  # a few edges in many partitions are many small files in each round
        after = _small_star(_large_star(now, few), few, parts).distinct()
        after, new_path, new_mark = _staged(after.coalesce(parts) if few else after, purpose)
        remove(now.sparkSession, path)
        now, path, before, mark = after, new_path, mark, new_mark
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
