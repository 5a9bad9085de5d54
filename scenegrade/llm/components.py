"""Connected components of a link table."""

from pyspark.sql import DataFrame, functions as F

from scenegrade.llm.common import stored


def _smallest_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_smallest_neighbour(both), "u").filter("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    best = _smallest_neighbour(down)
    others = down.join(best, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(best.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node in links (u, v).

    Large-star and small-star steps alternate until all links point at their component's smallest node; every step
    is stored, so nothing is recomputed and no link passes through the driver.
    """
    now = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now, before = stored(now, "links"), None
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    after = mark(now)
    while after != before and after[0]:
        before = after
        now = stored(_small_star(_large_star(now)), "links")
        after = mark(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
